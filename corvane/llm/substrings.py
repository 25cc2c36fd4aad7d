"""Removal of long repeated byte strings by refining buckets of q-grams, at anchors chosen by content.

Every string of `length` bytes holds an anchor: the place of the least q-gram hash among its first length - q + 1 places,
the leftmost of ties. Equal strings have their anchors at the same offset, so anchors stand for all strings around them.
An anchor's initial bucket is that of its q-gram. Buckets with one member are done. The others are refined by bucket
identifiers of longer strings around the anchor, made of those of their parts: for a block of offsets, the part that all
its strings share (the core) and the string that spans them all (the hull). A repeated hull settles its whole block, a
core that comes once settles it too; what is left is split into smaller blocks, down to single strings. Of members with
one hull, one goes on for all of them, so groups of equal passages shrink to one row a round.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path, small_batches

SEGMENT = 1 << 15
LOW = np.uint64((1 << 20) - 1)
ODD = np.uint64(0xBF58476D1CE4E5B9)
ROWS = "k1 long, k2 long, at long, w int, c long, s long"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@cache
def _lane(n: int, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and powers of an odd number and of its inverse, all modulo 2**64."""
    rng = np.random.Generator(np.random.PCG64(17 + lane))
    base = int(rng.integers(0, 2**63)) * 2 + 1
    up = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
    return rng.integers(0, 2**64, 256, dtype=np.uint64), up(base), up(pow(base, -1, 2**64))


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor's place in data, first and last string that chose it, and its q-gram's bucket, in order."""
    width, n = length - gram + 1, len(data)
    values, up, down = _lane(SEGMENT + length, 0)
    starts, ends = offsets[:-1], offsets[1:] - length + 1
    long_enough = np.flatnonzero(ends > starts)
    starts, ends, out = starts[long_enough], ends[long_enough], []
    for s in range(0, max(0, n - length + 1), SEGMENT):
        m = min(SEGMENT, n - length + 1 - s)
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(starts, s + m, "left")
        if a == b:
            continue
        x = data[s : s + m + length - 1]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(values[x] * up[: len(x)], out=sums[1:])
        bucket = (sums[gram:] - sums[:-gram]) * down[: len(x) - gram + 1]
        least = ((bucket ^ (bucket >> np.uint64(29))) * ODD & ~LOW) | np.arange(len(bucket), dtype=np.uint64)
        size = 1
        while size * 2 <= width:  # least of each window, by doubling
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        place = (np.minimum(least[:m], least[width - size : width - size + m]) & LOW).astype(np.int64)
        edges = np.zeros(m + 1, np.int32)
        np.add.at(edges, np.clip(starts[a:b] - s, 0, m), 1)
        np.add.at(edges, np.clip(ends[a:b] - s, 0, m), -1)
        valid = np.cumsum(edges[:m]) > 0
        turn = place[1:] != place[:-1]
        new, last = valid.copy(), valid.copy()
        new[1:] &= ~valid[:-1] | turn
        last[:-1] &= ~valid[1:] | turn
        first = np.flatnonzero(new)
        at = place[first]
        out.append((long_enough[a:b][np.searchsorted(starts[a:b], first + s, "right") - 1], at + s, first + s, np.flatnonzero(last) + s, bucket[at]))
    if not out:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    text, at, first, last, bucket = (np.concatenate(c) for c in zip(*out, strict=True))
    new = np.diff(at, prepend=-1) != 0  # one that is chosen on both sides of a segment's border came twice
    return text[new], at[new], first[new], last[np.append(new[1:], True)], bucket[new]


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and offsets, from 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pack(place, lo, hi) -> np.ndarray:
    return place << 32 | lo << 16 | hi


def _add_anchors(length: int, gram: int):
    def run(batches):
        kind = pa.struct([("at", pa.int64()), ("h", pa.int64())])
        for b in batches:
            data, offsets = _bytes(b.column("b"))
            text, at, first, last, h = _anchors(data, offsets, length, gram)
            packed = _pack(at - offsets[text], at - last, at - first)
            each = pa.StructArray.from_arrays([pa.array(packed, pa.int64()), pa.array(h.view(np.int64))], fields=list(kind))
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(b)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), each)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), pa.array(np.diff(offsets)), lists], ["doc_id", "sha", "n_bytes", "anchors"])

    return run


def _names(block: int, length: int, gram: int, chunk: int = 1024):
    """Rows of ROWS: for every ask and block of offsets the buckets of its core and of its hull, null where the hull
    leaves the text."""
    width = length - gram + 1
    around = width - 1 + length
    lanes = [_lane(around, i) for i in (0, 1)]

    def run(batches):
        for b in batches:
            data, offsets = _bytes(b.column("b"))
            asks = b.column("asks")
            flat = asks.flatten()
            if not len(flat):
                continue
            packed, weight = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            text = np.repeat(np.arange(len(b)), asks.value_lengths().to_numpy())
            place, lo, hi = packed >> 32, packed >> 16 & 0xFFFF, packed & 0xFFFF
            padded = np.concatenate([np.zeros(width - 1, np.uint8), data, np.zeros(length, np.uint8)])
            views = np.lib.stride_tricks.sliding_window_view(padded, around)
            sizes, k1, k2 = np.diff(offsets), b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for i in range(0, len(packed), chunk):
                now = slice(i, i + chunk)
                x = views[offsets[text[now]] + place[now]]
                sums = []
                for values, up, _ in lanes:
                    sums.append(np.zeros((len(x), around + 1), np.uint64))
                    np.cumsum(values[x] * up[:around], axis=1, out=sums[-1][:, 1:])
                low, many = lo[now] // block, hi[now] // block - lo[now] // block + 1
                row = np.repeat(np.arange(len(x)), many)
                k = low[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
                o1 = k * block
                o2 = np.minimum(o1 + block - 1, width - 1)
                name = lambda lane, start, end, row=row, sums=sums: (sums[lane][row, end] - sums[lane][row, start]) * lanes[lane][2][start]
                core = name(0, width - 1 - o1, width - 1 + length - o2) ^ ((k + 1).astype(np.uint64) * ODD)
                hull = name(1, width - 1 - o2, width - 1 + length - o1)
                p, t = place[now][row], text[now][row]
                outside = (p < o2) | (p + length - o1 > sizes[t])
                out = _pack(p, np.maximum(lo[now][row], o1), np.minimum(hi[now][row], o2))
                yield pa.RecordBatch.from_arrays([pa.array(k1[t]), pa.array(k2[t]), pa.array(out), pa.array(weight[now][row], pa.int32()), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64), mask=outside)], ["k1", "k2", "at", "w", "c", "s"])

    return run


def _blocks(width: int) -> list[int]:
    """Sizes of the rounds' blocks, each a multiple of the next: 301, 60, 12, 1 for strings of 400 bytes."""
    sizes, step = [1], 12
    while sizes[-1] * step * 2 <= width:
        sizes.append(sizes[-1] * step)
        step = 5
    return [width, *reversed(sizes)] if width > 1 else [1]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _settle(batches):
    """Maximal removed runs of each text, and what is left."""
    for b in batches:
        out = {"k1": [], "k2": [], "spans": [], "kept": []}
        for k1, k2, data, spans in zip(*(b.column(c) for c in ("k1", "k2", "b", "spans")), strict=True):
            data, cuts = data.as_py(), _merged([(s["start"], s["end"]) for s in spans.as_py()])
            places = [0, *(x for c in cuts for x in c), len(data)]
            out["k1"].append(k1.as_py())
            out["k2"].append(k2.as_py())
            out["spans"].append([{"start": a, "end": e} for a, e in cuts])
            out["kept"].append(b"".join(data[a:e] for a, e in zip(places[::2], places[1::2], strict=True)))
        yield pa.RecordBatch.from_pydict(out, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))


def _key(sha: Column, *names: str) -> dict[str, Column]:
    """The first two times 64 bits of a hash in hexadecimal."""
    return {c: F.conv(F.substring(sha, i, 16), 16, -10).cast("long") for c, i in zip(names, (1, 17), strict=True)}


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, bytes of the text, and its hash: in full, and as two numbers."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"), sha.alias("sha")).withColumns(_key(F.col("sha"), "k1", "k2"))


def _bucketed(df: DataFrame) -> DataFrame:
    """Write df by the text's key, so that joins with what the rounds find out move no texts."""
    spark, name = df.sparkSession, f"corvane_texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, "k1", "k2").option("path", new_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], n: int, how: str) -> DataFrame:
    """rows joined with groups (one row a key, `size`: the key's rows among n), inner or left. Groups of more than a
    thousandth of the n rows, of which there are less than a thousand, are broadcast: their rows stay where they lie."""
    is_large = F.col("size") * 1000 > n
    large = cut(groups.where(is_large), "large")
    common = rows.join(F.broadcast(large), keys)
    others = rows.join(F.broadcast(large), keys, "left_anti").join(groups.where(~is_large), keys, how)
    return common.unionByName(others).drop("size")


def _repeats(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, sha, n_bytes, k1, k2, n: rows with this text), and spans and kept bytes of the distinct texts
    that hold repeated strings and are not copies as a whole."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    key = ["k1", "k2"]
    rows = keyed.select("doc_id", "b", "sha").mapInArrow(_add_anchors(length, gram), f"doc_id {dict(keyed.dtypes)['doc_id']}, sha string, n_bytes long, anchors array<struct<at: long, h: long>>")
    rows = cut(rows.withColumns(_key(F.col("sha"), "k1", "k2")), "anchors")
    texts = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"))
    each = rows.select(*key, F.inline("anchors"))
    # buckets of q-grams: one place in one text, whatever its copies, isn't repeated
    mark = F.xxhash64("k1", "k2", F.shiftright("at", 32))
    repeated = each.groupBy("h").agg(F.min(mark).alias("a"), F.max(mark).alias("z")).where("a <> z").select("h")
    repeated = cut(repeated, "repeated")  # a table of its own, so that a join with it may split a very common bucket
    asks = each.join(repeated, "h", "left_semi").groupBy(*key).agg(F.collect_set("at").alias("asks"))
    asks = asks.join(texts, key).select(*key, "rep", F.transform("asks", lambda a: F.struct(a.alias("at"), F.when(F.col("n") > 1, 2).otherwise(1).alias("w"))).alias("asks"))
    wanted = keyed.alias("d").join(asks.alias("a"), (F.col("d.k1") == F.col("a.k1")) & (F.col("d.k2") == F.col("a.k2")) & F.col("d.doc_id").eqNullSafe(F.col("a.rep")))
    held = _bucketed(wanted.select("d.k1", "d.k2", "d.b", "a.asks"))
    spans, now = None, held
    lo, hi = F.shiftright("at", 16).bitwiseAND(0xFFFF), F.col("at").bitwiseAND(0xFFFF)
    blocks = _blocks(length - gram + 1)
    for block in blocks:
        named = now.mapInArrow(_names(block, length, gram), ROWS).withColumn("rid", F.monotonically_increasing_id())
        named = cut(named, f"block{block}")
        n, size = named.count(), F.count("*").alias("size")
        hulls = named.where("s is not null").groupBy("c", "s").agg(F.sum("w").alias("total"), F.min("rid").alias("first"), F.min(lo).alias("lo"), F.max(hi).alias("hi"), size).where("total >= 2")
        named = _joined(named, hulls, ["c", "s"], n, "left")
        if block != blocks[-1]:
            named = cut(named, f"marked{block}")
        start = F.shiftright("at", 32)
        found = named.where("total is not null and w = 1").select(*key, F.struct((start - hi).alias("start"), (start - lo + length).alias("end")).alias("span"))
        spans = found if spans is None else spans.unionByName(found)
        if block == blocks[-1]:
            break
        unsettled = F.col("total").isNull()
        cores = named.groupBy("c").agg(((F.sum("w") >= 2) & F.max(unsettled & (F.col("w") == 1))).alias("going"), size)
        left = _joined(named.where(unsettled | (F.col("rid") == F.col("first"))), cores, ["c"], n, "inner").where("going")
        whole = F.shiftleft(start, 32).bitwiseOR(F.shiftleft(F.col("lo").cast("long"), 16)).bitwiseOR(F.col("hi").cast("long"))
        again = F.struct(F.when(unsettled, F.col("at")).otherwise(whole).alias("at"), F.when(unsettled, F.col("w")).otherwise(2).alias("w"))
        now = held.drop("asks").join(left.groupBy(*key).agg(F.collect_list(again).alias("asks")), key)
    spans = spans.groupBy(*key).agg(F.collect_list("span").alias("spans"))
    settled = held.drop("asks").join(spans, key).mapInArrow(_settle, "k1 long, k2 long, spans array<struct<start: long, end: long>>, kept binary")
    return rows.drop("anchors").join(texts.select(*key, "n"), key), settled


def repeated_spans(docs: DataFrame, length: int = 400, gram: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_bytes, spans (maximal runs of bytes that are covered by a string of `length` bytes
    which also starts elsewhere, in any document or the same one; start and end as byte offsets), kept_sha256 of the
    bytes outside them.

    Texts count as UTF-8 bytes, null as an empty text. Rows with equal texts are copies of each other, also where their
    doc_id is equal or null; such texts of `length` bytes or more are one span. Texts under `length` bytes have none.
    Other columns are ignored. A text goes to one task; it is read in segments, so its memory is a few times its size.
    Strings are equal if two hashes of 64 bits agree, one of their core and one of their hull."""
    docs, settled = _repeats(docs, length, gram or max(1, length // 4))
    settled = settled.select("k1", "k2", "spans", F.sha2("kept", 256).alias("kept_sha256"))
    every = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    spans = F.when(every, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")))
    kept = F.when(every, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha"))
    return docs.join(settled, ["k1", "k2"], "left").select("doc_id", "n_bytes", spans.alias("spans"), kept.alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 400, gram: int | None = None) -> DataFrame:
    """docs with `kept` (binary): the bytes of the text outside its repeated spans, see repeated_spans(). A column of
    that name is replaced. Cut places may lie within a character, so the bytes are not always valid UTF-8."""
    own, settled = _repeats(docs, length, gram or max(1, length // 4))
    copies = own.where((F.col("n") > 1) & (F.col("n_bytes") >= length)).select("k1", "k2", F.lit(True).alias("copy")).distinct()
    named = docs.drop("kept").withColumns(_key(F.sha2(F.coalesce("text", F.lit("")), 256), "__k1", "__k2"))
    found = copies.join(settled.select("k1", "k2", "kept"), ["k1", "k2"], "full").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "copy", "kept")
    found = found.select("__k1", "__k2", F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("__kept"))
    out = named.join(found, ["__k1", "__k2"], "left").withColumn("kept", F.coalesce("__kept", F.coalesce("text", F.lit("")).cast("binary")))
    return out.select(*[c for c in docs.columns if c != "kept"], "kept")
