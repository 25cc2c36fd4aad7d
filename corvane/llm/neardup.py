"""Near duplicates: a similarity self-join of shingle sets by chosen paths, and the components of its links.

Documents with equal sets become one representative first. Each of `trees` independent trees takes a representative by
one of its minwise tokens and sends it down one or two more, selected at every node. A node with at most `small` members compares all of them; a
larger one compares each member with a hub of its own. Candidates pass a signature test with a wide margin and are
confirmed on full sets. Large nodes at the roots whose members are in one component by then are done; those with few
members outside their main component compare these with all members, in blocks; the others branch again, and what is
still large after `levels` levels is compared in blocks as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import components
from .shingles import minhash, mix, shingle_sets

SLOTS = 64  # minwise values of a signature; one byte of each is kept


def _signatures(width: int, roots: int):
    slots, seeds = np.arange(SLOTS), mix(np.arange(1, roots + 1, dtype=np.uint64))
    assert roots <= SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sketch, nodes = [], [], [], [], []
            for s in shingle_sets(b.column("text"), width):
                n.append(len(s))
                if not len(s):
                    h1.append(0), h2.append(0), sketch.append(b""), nodes.append([])
                    continue
                h1.append(int(s.sum().view(np.int64)))
                h2.append(int(mix(s).sum().view(np.int64)))
                low = mix(minhash(s, SLOTS) + slots.astype(np.uint64))
                sketch.append((low & np.uint64(255)).astype(np.uint8).tobytes())
                nodes.append(mix(low[:roots] ^ seeds).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "sketch", "nodes"])

    return run


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)


def _pairs(out: list) -> pa.RecordBatch:
    a, b, e = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
    low, high = np.minimum(a, b), np.maximum(a, b)
    keep = low != high
    return pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64)) for x in (high, low, e)], ["a", "b", "est"])


def _within_small(least: int):
    """Candidates among all members of a node that aren't in one component yet."""

    def run(batches):
        for batch in batches:
            members = batch.column("members")
            flat, ends = members.flatten(), members.offsets.to_numpy() - members.offsets[0].as_py()
            ids, comp, sk, out = flat.field("rep").to_numpy(), flat.field("comp").to_numpy(), _matrix(flat.field("sketch")), []
            for i, j in zip(ends, ends[1:], strict=False):
                for k in range(i, j - 1):
                    same = (sk[k + 1 : j] == sk[k]).sum(axis=1)
                    keep = (same >= least) & (comp[k + 1 : j] != comp[k])
                    if keep.any():
                        out.append((np.full(keep.sum(), ids[k]), ids[k + 1 : j][keep], same[keep]))
            yield _pairs(out)

    return run


def _with_hub(least: int):
    def run(batches):
        for b in batches:
            same = (_matrix(b.column("sketch")) == _matrix(b.column("hub_sketch"))).sum(axis=1) if b.num_rows else np.zeros(0, np.int64)
            keep = same >= least
            yield _pairs([(b.column("rep").to_numpy()[keep], b.column("hub").to_numpy()[keep], same[keep])])

    return run


def _pack(s: np.ndarray) -> bytes:
    """The upper 48 bits of a sorted set, the highest byte of all first: sorted high bytes compress well. Two sets of
    20,000 shingles have a chance of 1 in 700,000 to share a value by accident."""
    return np.unique(s >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, 2:] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = np.concatenate([p, q])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _between_blocks(least: int, percent: int):
    """Confirmed links between components, one for each minor member and other component: no more change the result."""

    def run(key, table):
        t = table.combine_chunks()
        ids, comp, sk, minor = t["rep"].to_numpy(), t["comp"].to_numpy(), _matrix(t["sketch"]), t["minor"].to_numpy(zero_copy_only=False)
        sets = [_unpack(x) for x in t["shingles"].to_pylist()]
        role = t["role"].to_numpy()
        m, o = np.flatnonzero((role == 1) | (role == 0) & minor), np.flatnonzero(role != 1)
        sizes, rows = np.array([len(x) for x in sets]), []
        for i in m:
            near = (sk[o] == sk[i]).sum(axis=1)
            fits = (100 * np.minimum(sizes[o], sizes[i]) >= percent * np.maximum(sizes[o], sizes[i])) & (comp[o] != comp[i]) & (near >= least)
            done = set()
            for j in o[fits][np.argsort(-near[fits], kind="stable")]:
                if comp[j] not in done and _linked(sets[i], sets[j], percent):
                    done.add(comp[j])
                    rows.append((ids[i], ids[j]))
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


PAIR = "a long, b long, est long"


def _branch(rows: DataFrame, percent: int) -> DataFrame:
    """Children of each node, by different slots that the node's hash selects: 100 / percent of them on average, as many
    as keep the expected number of paths that two members just similar enough share."""
    whole, rest = divmod(100, percent)
    first = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(SLOTS))
    step = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SLOTS // 2)) * 2 + 1  # odd: no slot comes twice
    slots = [F.pmod(first + step * k, F.lit(SLOTS)).cast("int") for k in range(whole + 1)]
    kids = [F.xxhash64("node", s, F.substring("sketch", s + 1, F.lit(1))) for s in slots]
    more = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(percent)) < rest
    return rows.select("rep", "sketch", "comp", F.explode(F.when(more, F.array(*kids)).otherwise(F.array(*kids[:-1]))).alias("node"))


def _held(df: DataFrame, most: int = 4_000_000) -> DataFrame:
    """df to be broadcast if it's counted to have at most `most` rows of a few numbers; beyond that a join picks its own
    way. df is cheap to count: a table that has been written."""
    return F.broadcast(df) if df.count() <= most else df


def _level(rows: DataFrame, small: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of the nodes of one level and the rows of its large nodes; rows: rep, sketch, comp, node. Nodes
    whose members are all in one component make neither."""
    own = F.xxhash64("rep", "node")
    stats = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(own).alias("hub")).where("n > 1 and lo <> hi")
    joined = cut(rows.join(stats.select("node", "n", "hub"), "node").withColumn("hub", own == F.col("hub")), "level")
    bounded = joined.where(F.col("n") <= small).groupBy("node").agg(F.collect_list(F.struct("rep", "sketch", "comp")).alias("members"))
    large = joined.where(F.col("n") > small)
    hubs = large.where("hub").select("node", F.col("rep").alias("hub"), F.col("sketch").alias("hub_sketch"), F.col("comp").alias("hub_comp"))
    spokes = large.drop("hub").join(_held(hubs), "node").where("comp <> hub_comp").select("rep", "sketch", "hub", "hub_sketch")
    return bounded.select("members").mapInArrow(_within_small(least), PAIR).unionByName(spokes.mapInArrow(_with_hub(least), PAIR)), large.select("rep", "sketch", "comp", "node")


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("est").alias("est"))


def _labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with comp as labels have it; a representative without a label is its own."""
    return rows.drop("comp").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _open(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the large nodes that aren't in one component, with `outside`: members not in the node's main one."""
    rows = cut(_labelled_rows(large, labels), "large")
    parts = rows.groupBy("node", "comp").agg(F.count("*").alias("c")).groupBy("node").agg((F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
    return cut(rows.join(parts, "node"), "open")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            keep = []
            for x, y in zip(a, b, strict=True):
                keep.append(_linked(_unpack(x), _unpack(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = _held(pairs.select("a", "b"))  # then a set moves once for each of its pairs, and those of b once
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")).join(pairs, "a")
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")).join(pairs.select("b"), "b", "left_semi")
    return left.join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own := [_pack(s) for s in shingle_sets(b.column("text"), width)], pa.binary()), pa.array([len(s) for s in own], pa.int64())], ["rep", "shingles", "bytes"])

    return docs.select("doc_id", "text").join(_held(wanted.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi").mapInArrow(run, "rep long, shingles binary, bytes long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 8, small: int = 24, levels: int = 3, block_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text; other columns are ignored).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles.
    component_id is the smallest doc_id reachable over links, kept is doc_id = component_id. Null and wordless texts
    have no shingles and no links. Rows that share a doc_id are one document: they get one component. A null doc_id
    takes no part: component_id null, kept true. No cap drops pairs; recall is that of the trees: a pair just at 0.8
    meets with probability 1 - (1 - .8)**trees at the first level, over 0.99999 with the defaults, and over 0.999 at the
    third. percent is 50 at least.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = cut(docs.mapInArrow(_signatures(width, trees), "doc_id long, n long, h1 long, h2 long, sketch binary, nodes array<long>"), "signatures")
    live = sigs.where("n > 0 and doc_id is not null")
    equal = live.groupBy("n", "h1", "h2")
    reps = equal.agg(F.min("doc_id").alias("rep"))
    firsts = equal.agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))  # alike for equal sets
    least = int(SLOTS * percent / 100 - 4.5 * (SLOTS * percent / 100 * (1 - percent / 100)) ** 0.5)
    found, large = _level(firsts.select("rep", "sketch", F.col("rep").alias("comp"), F.explode("nodes").alias("node")), small, least)
    pairs = cut(_best(found), "pairs")

    sets = cut(_sets_of(docs, cut(_ends(pairs), "wanted"), width), "sets")
    # one document's closest candidate first: most components are whole after that, and their other pairs need no test
    closest = cut(pairs.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b")), "closest")
    labels = cut(components(cut(_confirm(closest, sets, percent), "links")), "labels")
    labels = _merged(labels, cut(_confirm(cut(_across(pairs, labels), "across"), sets, percent), "links"))

    rows = _open(large, labels)
    if not rows.isEmpty():
        deep, rows, pairs = rows.where(F.col("outside") <= small).select("rep", "sketch", "node"), rows.where(F.col("outside") > small), None
        for _ in range(levels - 1):
            found, rows = _level(_branch(rows, percent), small, least)
            pairs = found if pairs is None else pairs.unionByName(found)
        deep = cut(deep.unionByName(rows.select("rep", "sketch", "node")), "deep")
        pairs = cut(_best(pairs), "pairs") if pairs is not None else None
        # members of nodes compared in blocks may meet any other member
        wanted = deep.select("rep") if pairs is None else deep.select("rep").unionByName(_ends(pairs))
        missing = cut(wanted.distinct().join(sets, "rep", "left_anti"), "wanted")
        sets = sets.unionByName(cut(_sets_of(docs, missing, width), "sets"))
        if pairs is not None:
            labels = _merged(labels, cut(_confirm(cut(_across(pairs, labels), "across"), sets, percent), "links"))
        labels = _merged(labels, cut(_residual(deep, labels, sets, least, percent, block_bytes), "links"))
    same_id = live.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    repeated = live.join(same_id, "doc_id", "left_semi").join(reps, ["n", "h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = _merged(labels, cut(repeated, "links"))

    # empty texts meet nothing: they take no part in the join, where all of them would have one key
    out = live.join(reps, ["n", "h1", "h2"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", "n", F.coalesce("component", "rep").alias("component_id")).unionByName(sigs.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components, with these as ca and cb; a node without a label is its own."""
    left = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    named = pairs.join(left, "a", "left").join(right, "b", "left")
    return named.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    return _labelled(pairs, labels).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only links between components count, as edges of a graph of components."""
    if links.isEmpty():
        return labels
    joined = _labelled(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = cut(components(joined), "merged")
    known = labels.unionByName(merged.select("node", F.col("node").alias("component"))).distinct()
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = known.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return cut(known, "labels")


def _residual(deep: DataFrame, labels: DataFrame, sets: DataFrame, least: int, percent: int, block_bytes: int) -> DataFrame:
    """Links between components within the nodes that stayed large: members outside a node's main component are compared
    with all its members, everything else being in one component already. Sets are dealt into blocks of about
    block_bytes; a node of one block gets each set once."""
    rows = cut(_labelled_rows(deep, labels).join(sets.select("rep", "bytes"), "rep"), "residual")
    sizes = rows.groupBy("node", "comp").agg(F.sum("bytes").alias("c"))
    main = sizes.groupBy("node").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("c")).where("n > c")
    rows = rows.join(main, "node").withColumn("minor", F.col("comp") != F.col("main"))
    rows = rows.withColumn("n_all", F.ceil(F.col("n") / block_bytes)).withColumn("n_minor", F.ceil((F.col("n") - F.col("c")) / block_bytes))
    at, own = F.xxhash64("rep", F.lit(3)), ["node", "rep", "sketch", "comp", "minor"]
    copy = lambda df, role, bm, bo: df.select(*own, F.lit(role).alias("role"), bm.cast("long").alias("bm"), bo.cast("long").alias("bo"))
    many = rows.where("n_all > 1")
    dealt = copy(rows.where("n_all = 1"), 0, F.lit(0), F.lit(0)).unionByName(
        copy(many.where("minor").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1))), 1, F.pmod(at, F.col("n_minor")), F.col("k"))
    ).unionByName(copy(many.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_minor") - 1))), 2, F.col("k"), F.pmod(at, F.col("n_all"))))
    dealt = cut(dealt, "dealt")  # without the sets its size is known: few rows are broadcast to the sets
    return dealt.join(sets.select("rep", "shingles"), "rep").groupBy("node", "bm", "bo").applyInArrow(_between_blocks(least, percent), "a long, b long").distinct()
