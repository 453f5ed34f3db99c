"""N-gram Jaccard join: exact links and components of documents whose sets of word shingles are within a Jaccard distance.

The Jaccard distance is a metric, and pivots divide the space. Texts that share nothing are at distance 1 from each other, so
document pivots alone cannot part them; the first pivots are therefore single shingles, rarest first: a document's regions are
those of its nearest pivots, as many as a partner within the radius may lack, and one more. The most central document of a
region is its document pivot, and regions with one document pivot are one cell: its members within the radius are linked through
it and need no further comparison with each other.

A cell whose members are not yet connected is joined by their differences from its pivot. A small one ends in one task. Of a large one
only members go on that can have a partner of another label: of two linked members of which one lies beyond the radius of the
pivot, both deviate from it in common, and the counts follow from the triangle inequality of set differences. They are dealt over
blocks by their distance to the pivot, and pairs of blocks whose distances can have links are joined, each in one task. Nothing
is divided again, so members that lie just beyond the radius of each other and share what they differ in cost a comparison each,
and no further copies of their differences. Pairs already in one component are never formed. Whole sets, or whole differences,
decide every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fingerprint, forget, keep_told, maybe_broadcast, stash, table
from .components import components

WORDS = 4
PERCENT = 85
#: A cell, or one of two blocks, of at most so many members and shingles of their differences is joined in one task.
LEAF_MEMBERS, LEAF_SHINGLES = 1024, 1 << 18


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a text, A-Z lower-cased; of the whole sequence if it
    has fewer words; empty without words."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(h) - words + 1
    mixed = h[:n]
    for k in range(1, words):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def _needed(n: int, percent: int) -> int:
    """Shingles that a partner shares at least with a set of ``n``."""
    return -(-percent * n // 100)


def _least_hits(spare):
    """Shingles of its head that a set with ``spare`` more than it needs shares with another one, if the two are linked: half as
    many as it may lack. More would be a sharper test and longer heads."""
    return (spare + 2) // 2 if isinstance(spare, int) else F.expr(f"({spare} + 2) div 2")


def shingle_table(rows: DataFrame, whole: bool, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``rows`` with ``text`` replaced by n, digest (of the set, 128 bits; null if empty) and hashes: the whole set, or its head
    by hash.

    Of a pair that shares k shingles, heads of n - k + m share m. A head holds one more than n - needed + m shingles with m of
    ``_least_hits``, as a partner that is smaller by one may have the m that is smaller by one."""
    carried = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = b.column("text")
            for at in range(0, len(texts), 500):
                sets = [shingle_set(t, words) for t in texts.slice(at, 500).to_pylist()]
                heads = sets if whole else [s[: (spare := len(s) - _needed(len(s), percent)) + _least_hits(spare) + 1] for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                flat = np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(c).slice(at, 500) for c in carried],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    [*carried, "n", "digest", "hashes"],
                )

    d = rows.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    schema = "".join(f"{c} {t}, " for c, t in rows.dtypes if c != "text")
    return d.mapInArrow(run, f"{schema}n long, digest binary, hashes array<long>")


def _needed_col(n: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * n / 100).cast("long")


def _candidates(heads: DataFrame, percent: int) -> DataFrame:
    """(doc_id, digest, n) of the rows that have as many head shingles in common with other rows as a partner needs."""
    tokens = heads.select("row", F.explode("hashes").alias("h"))
    shared = tokens.groupBy("h").count().where("count > 1").select("h")
    hits = tokens.join(shared, "h").groupBy("row").agg(F.count("*").alias("hits"))
    rows = heads.where("n > 0").select("row", "doc_id", "digest", "n").join(hits, "row")
    rows = rows.withColumn("spare", F.col("n") - _needed_col(F.col("n"), percent))
    return rows.where(F.col("hits") >= _least_hits("spare")).select("doc_id", "digest", "n")


def _labelled(rows: DataFrame, named: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component found so far of a node; a node without links is its own."""
    found = named.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(found, node, "left").withColumn(name, F.coalesce(name, node))


def _merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (x, p): those found so far count as one node each."""
    between = stash(_labelled(_labelled(links, named, "x", "a"), named, "p", "b").select("a", "b").where("a <> b").distinct(), "between")
    if between.isEmpty():
        return named
    top = components(between, "a", "b")
    old = named.join(top.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    old = old.select("node", F.coalesce("_to", "component").alias("component"))
    return stash(old.unionByName(top.join(named.select("node"), "node", "left_anti")), "components")


def _difference(a: str, b: str) -> Column:
    """The shingles that one of two sets has."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _linked(common: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * common >= percent * (n + m - common)


def _first_cells(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells of document pivots over regions by single shingles: (components of the links to nearest pivots, further links,
    members of the cells that are not one component yet). ``sets``: node, n, hashes."""
    tokens = sets.select("node", "n", F.explode("hashes").alias("h"))
    often = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("by"))
    lone = F.col("n") - F.size("by")
    window = F.col("n") - _needed_col(F.col("n"), percent) + 1 - lone
    near = shared.withColumn("lone", lone).withColumn("near", window).where("near > 0")
    regions = near.select("node", "n", "lone", F.explode(F.slice("by", F.lit(1), F.col("near").cast("int"))["h"]).alias("region"))
    regions = stash(regions, "regions")  # a region of one has no partner for it
    center = F.min(F.struct((F.col("lone") / F.col("n")).alias("lone"), "node", "n"))
    pivots = regions.groupBy("region").agg(center.alias("_p"), F.count("*").alias("m")).where("m > 1")
    pivots = pivots.select("region", F.col("_p.node").alias("p"), F.col("_p.n").alias("np"))
    met = regions.join(pivots, "region").where("node <> p").groupBy(F.col("node").alias("x"), "p")
    met = stash(met.agg(F.count("*").alias("votes"), F.first("n").alias("n"), F.first("np").alias("np")), "met")
    forget(regions)

    alike = 100 * F.least("n", "np") >= percent * F.greatest("n", "np")
    first = met.where(alike).groupBy("x").agg(F.max_by("p", F.struct("votes", (-F.col("p")).alias("_low"))).alias("p"))
    links = stash(_measured(first, sets, percent).where("linked").select("x", "p"), "links")
    named = stash(components(links, "x", "p"), "components")

    labelled = _labelled(_labelled(met.select("x", "p"), named, "x", "label"), named, "p", "home")
    opened = stash(labelled.where("label <> home").select("p").distinct(), "open")
    rows = labelled.join(maybe_broadcast(opened), "p", "left_semi")
    cells = stash(
        _measured(rows, sets, percent).select(
            F.col("p").alias("cell"), F.col("np").alias("pn"), "home", F.col("x").alias("node"), "n", "c",
            F.when(F.col("linked"), F.col("home")).otherwise(F.col("label")).alias("label"), "delta", "linked", F.col("label").alias("_was"),
        ),
        "cells",
    )
    more = cells.where("linked AND _was <> home").select(F.col("node").alias("x"), F.col("cell").alias("p"))
    forget(links, opened)
    return named, more, cells.drop("linked", "_was")


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (x, p) with the sizes n and np, the common shingles c, the difference of the sets and whether they are linked.
    Only the sets of nodes in pairs move."""
    pairs = stash(pairs, "pairs")
    few = maybe_broadcast(stash(pairs.select("x").distinct(), "ends"))
    x = sets.select(F.col("node").alias("x"), "n", F.col("hashes").alias("hx")).join(few, "x", "left_semi")
    few = maybe_broadcast(stash(pairs.select("p").distinct(), "ends"))
    p = sets.select(F.col("node").alias("p"), F.col("n").alias("np"), F.col("hashes").alias("hp")).join(few, "p", "left_semi")
    both = pairs.join(x, "x").join(p, "p").withColumn("delta", _difference("hx", "hp")).drop("hx", "hp")
    both = both.withColumn("c", F.expr("(n + np - size(delta)) div 2"))
    return both.withColumn("linked", _linked(F.col("c"), F.col("n"), F.col("np"), percent))


def _blocks(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks of cells that are too large for one task: the last pivot's size ``pn`` and ``members``, those of both blocks.

    ``cells``: the pivot ``cell``, its size ``pn`` and label ``home``, and of each member: node, n, common shingles ``c`` with the
    pivot, label (members with one label are connected) and its difference ``delta`` from it.

    Two sets x and y with k shingles in common share pn - c_x - c_y + k of their differences, and a link needs
    k >= percent (n_x + n_y) / (100 + percent): so they share at least s_x + s_y, with s = pn / 2 - c + percent n / (100 + percent),
    and at least 1, as members within the radius of the pivot bear one label. Neither can share more than the ``u`` shingles of
    its difference that members of another label have too. With g = u - s, a link needs s_y <= g_x and s_x <= g_y; the greatest
    g by s of a cell, as whole numbers, tells which members can have a partner and the least ``o`` that they share with one. Then
    members whose heads (all but o - 1 of the difference, rarest first) share no shingle with another label have no link.

    Members that are left are dealt by hash over blocks of like distance to the pivot. By the triangle inequality blocks whose
    distances differ by more than the radius have no links with each other; two blocks of the pivot's own label need none. Every
    other pair of blocks is joined in a task of its own, so the tasks' number grows with the square of a cell's members that can
    have a partner, and what one task holds does not.

    Files of members are far smaller than their rows, as members of a cell differ alike; so Spark is told not to broadcast them by
    the size of their files."""
    tokens = cells.select("cell", "node", "label", F.explode("delta").alias("h"))
    held = tokens.groupBy("cell", "h").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    held = held.where("lo <> hi").select("cell", "h", "df")
    by = tokens.join(held.hint("merge"), ["cell", "h"]).groupBy("cell", "node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("by"))
    rows = cells.withColumn("main", F.col("label") == F.col("home")).withColumn("size", F.size("delta")).drop("delta", "home").join(by.hint("merge"), ["cell", "node"])
    rows = rows.withColumn("s", F.col("pn") / 2 - F.col("c") + percent / (100 + percent) * F.col("n"))
    rows = stash(rows.withColumn("g", F.size("by") - F.col("s") + 1e-6), "rows")
    steps = rows.groupBy("cell", "main", F.floor("s").alias("s")).agg(F.max("g").alias("g"))
    profile = stash(steps.groupBy("cell").agg(F.collect_list(F.struct("main", "s", "g")).alias("profile")), "profile")  # as many as differences have sizes
    fits = lambda t: (~t["main"] | ~F.col("main")) & (t["s"] <= F.col("g")) & (F.col("s") <= t["g"])
    able = rows.join(maybe_broadcast(profile, 1000), "cell").withColumn("partner", F.array_min(F.filter("profile", fits)["s"])).where("partner IS NOT NULL")
    o = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("s") + F.col("partner") - 1e-6))
    able = able.withColumn("take", (F.size("by") - o + 1).cast("int")).where("take > 0")
    regions = stash(able.select("cell", "node", "label", F.explode(F.slice("by", F.lit(1), F.col("take"))["h"]).alias("h")), "regions")
    met = regions.groupBy("cell", "h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cell", "h")
    heads = regions.join(met.hint("merge"), ["cell", "h"]).select("cell", "node").distinct()

    radius = 1 - percent / 100
    band = F.floor((1 - F.col("c") / (F.col("n") + F.col("pn") - F.col("c"))) / (radius / 2 + 1e-9))
    rows = rows.withColumn("far", ~F.col("main")).withColumn("band", band).withColumn("by", F.col("by")["h"]).drop("s", "g", "main", "size")
    rows = stash(rows.join(heads.hint("merge"), ["cell", "node"], "left_semi"), "distances")
    of = ["cell", "far", "band"]
    many = F.greatest(F.ceil(F.count("*") / max(1, LEAF_MEMBERS)), F.ceil(F.sum(F.size("by")) / LEAF_SHINGLES)).cast("int").alias("many")
    dealt = stash(rows.groupBy(*of).agg(many), "sizes")
    block = lambda k: F.struct("far", "band", k.alias("k"))
    every = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("_k"), "far", "band").select("cell", block(F.col("_k")).alias("a"))
    pairs = every.join(every.select("cell", F.col("a").alias("b")), "cell")
    pairs = pairs.where((F.col("a") <= F.col("b")) & F.col("b")["far"] & (F.abs(F.col("a")["band"] - F.col("b")["band"]) <= 2))
    pairs = stash(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = pairs.select("cell", "pair", F.col("a").alias("block"), (F.col("a") < F.col("b")).alias("left"))
    sides = stash(sides.unionByName(pairs.where("a < b").select("cell", "pair", F.col("b").alias("block"), F.lit(False).alias("left"))), "sides")
    rows = rows.join(maybe_broadcast(dealt), of).withColumn("block", block(F.pmod(F.xxhash64("node"), F.col("many")).cast("int")))
    rows = rows.join(maybe_broadcast(sides), ["cell", "block"])
    member = F.struct("node", "n", "c", "label", "left", F.col("by").alias("delta"))
    return rows.groupBy("pair").agg(F.first("pn").alias("pn"), F.collect_list(member).alias("members"))


def small_cell_links(pn: int, node, n, c, label, sizes, flat, percent: int, left=None) -> list[tuple[int, int]]:
    """Links (x, p) that connect all linked members of one cell: arrays of the members' columns as in ``_blocks``, their
    differences one after the other in ``flat``, ``sizes`` long. Shingles that members of one label alone have may be left out.
    If ``left`` is true for some members, only pairs of one of them and one of the others are compared.

    Each member not of the most common label (each one that is not left) meets those that can share enough with it and whose
    distance to the pivot differs from its own by at most the radius; what they share is counted from lists of the holders of
    each shingle."""
    if not len(flat):
        return []
    member = np.repeat(np.arange(len(node)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    shingles, token = np.unique(flat, return_inverse=True)
    _, root = np.unique(label, return_inverse=True)
    low, high = np.full(len(shingles), len(node)), np.full(len(shingles), -1)
    np.minimum.at(low, token, root[member])
    np.maximum.at(high, token, root[member])
    shared = low != high  # others share no more of a difference
    useful = np.bincount(member[shared[token]], minlength=len(node))
    holders = member[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token, minlength=len(shingles)))
    begins = np.concatenate([[0], ends[:-1]])
    distance = 1 - c / (n + pn - c)
    across = left is not None and left.any()
    found = []
    for q in np.flatnonzero(~left if across else root != np.bincount(root).argmax()):
        need = -(-percent * (n + n[q]) // (100 + percent))
        able = (root != root[q]) & (np.minimum(useful, useful[q]) >= pn - c - c[q] + need)
        able &= np.abs(distance - distance[q]) <= 1 - percent / 100 + 1e-9
        if across:
            able &= left
        if not able.any():
            continue
        own = token[starts[q] : starts[q + 1]]
        own = own[shared[own]]
        both = np.bincount(np.concatenate([holders[begins[t] : ends[t]] for t in own]), minlength=len(node)) if len(own) else np.zeros(len(node), np.int64)
        common = both - pn + c + c[q]
        for x in np.flatnonzero(able & (100 * common >= percent * (n + n[q] - common))):
            if root[x] != root[q]:
                found.append((int(node[x]), int(node[q])))
                root[root == root[x]] = root[q]
    return found


def _links_in_cells(cells: DataFrame, percent: int) -> DataFrame:
    """Links (x, p) of whole small cells or of pairs of blocks, each gathered in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            found = []
            for pn, cell in zip(b.column("pn").to_pylist(), b.column("members")):
                node, n, c, label, left, delta = cell.values.flatten()
                sizes = pc.list_value_length(delta).to_numpy().astype(np.int64)
                values = [x.to_numpy().astype(np.int64) for x in (node, n, c, label)]
                left = left.to_numpy(zero_copy_only=False).astype(bool)
                found += small_cell_links(pn, *values, sizes, delta.flatten().to_numpy(), percent, left)
            x, p = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(p, pa.int64())], ["x", "p"])

    return cells.select("pn", "members").mapInArrow(run, "x long, p long")


def _node_components(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the nodes that link with another. ``sets``: node, n, hashes."""
    named, more, cells = _first_cells(sets, percent)
    sizes = cells.groupBy("cell").agg(
        F.count("*").alias("members"), F.sum(F.size("delta")).alias("shingles"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    small = (F.col("members") <= LEAF_MEMBERS) & (F.col("shingles") <= LEAF_SHINGLES)
    opened = stash(sizes.where("lo <> hi").select("cell", small.alias("small")), "sizes")
    some = cells.join(maybe_broadcast(opened.where("small")), "cell", "left_semi")
    members = F.collect_list(F.struct("node", "n", "c", "label", F.lit(False).alias("left"), "delta")).alias("members")
    every = more.unionByName(stash(_links_in_cells(some.groupBy("cell").agg(F.first("pn").alias("pn"), members), percent), "links"))
    large = opened.where("NOT small")
    if not large.isEmpty():
        wide = stash(cells.join(maybe_broadcast(large), "cell", "left_semi"), "cells")
        every = every.unionByName(stash(_links_in_cells(_blocks(wide, percent), percent), "links"))
    return _merged(named, every)


def _named_sets(docs: DataFrame, heads: DataFrame, words: int, percent: int) -> DataFrame:
    """(digest, component) of the sets that may have a partner; ``heads`` has the rows of ``docs`` with doc_id, n, digest, hashes
    and row."""
    some = _candidates(heads, percent)
    nodes = some.groupBy("digest").agg(F.min("doc_id").alias("label"), F.max("n").alias("n"))
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    ids = nodes.select(F.col("label").alias("_id"))
    chosen = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = shingle_table(chosen.select("text"), True, words, percent).select("digest", "hashes").dropDuplicates(["digest"])
    sets = stash(sets.join(nodes.select("digest", "node", "n"), "digest").select("node", "n", "hashes"), "sets")
    found = _node_components(sets, percent)
    named = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    named = stash(named, "named")
    forget(sets, nodes)
    return named


def jaccard_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable by links, itself included.

    Two documents link when ``percent`` of their shingles' union is common. Rows with equal sets are one node, so copies are
    compared once. Null and blank texts have no shingles and link with nothing. Repeated rows fall in one component; a null
    doc_id is no component's name unless all of it have none. An empty table gives an empty result. Very long texts are taken
    whole. Shingles are told apart by 64-bit hashes. Other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = stash(shingle_table(rows, False, words, percent).withColumn("row", F.monotonically_increasing_id()), "heads")
    named = _named_sets(rows, heads, words, percent)
    labels = heads.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("label"))
    lowest = stash(named.join(labels, "digest").groupBy("component").agg(F.min("label").alias("lowest")), "lowest")
    named = maybe_broadcast(stash(named.join(maybe_broadcast(lowest), "component").select("digest", "lowest"), "named"))
    rows = heads.select("doc_id", "n", "digest")
    empty = F.col("digest").isNull()  # not joined, as all of them would meet in one task
    out = rows.where(~empty).join(named, "digest", "left").unionByName(rows.where(empty).withColumn("lowest", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, all columns: the one with the smallest doc_id (null last), of those with equal ids
    the one with the smallest fingerprint of all columns, of rows equal in all columns any one.

    Rows are told apart by doc_id and fingerprint, so an unrelated row that repeats an id stays and a copy without id goes.
    Rows without words stay. An empty table stays empty."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *fingerprint(docs))
    heads = stash(shingle_table(marked, False, words, percent).withColumn("row", F.monotonically_increasing_id()), "heads")
    named = _named_sets(marked, heads, words, percent)
    grouped = heads.where("n > 0").select("doc_id", "f1", "f2", "digest").join(maybe_broadcast(named), "digest")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "f1", "f2")
    keepers = grouped.groupBy("component").agg(F.min(place).alias("keeper"), F.count("*").alias("rows")).where("rows > 1")
    keepers = maybe_broadcast(stash(keepers, "keepers"))
    return keep_told(docs, grouped.join(keepers, "component").select("doc_id", "f1", "f2", (place == F.col("keeper")).alias("keeps")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
