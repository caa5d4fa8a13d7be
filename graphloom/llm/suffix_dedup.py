"""Repeated byte strings: names of growing strings around sampled positions, refined until unique or long enough."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table

#: Positions that are hashed at once; a local position must fit in POS_BITS.
BLOCK, POS_BITS = 1 << 19, 20
#: Two independent odd bases for polynomial hashes modulo 2**64 over random byte values.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base**i, base**-i (modulo 2**64) for i < n, and the value of each byte."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), np.random.default_rng(base & 0xFFFF).integers(0, 2**64, 256, np.uint64, endpoint=False)


def _prefix(data: np.ndarray, base: int) -> np.ndarray:
    up, _, value = _powers(base, 2 * BLOCK)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of data[start:end] for each pair; the strings are shorter than BLOCK."""
    out = np.zeros((2, len(start)), np.uint64)
    order = np.argsort(start, kind="stable")
    edges = np.searchsorted(start[order], np.arange(0, len(data) + BLOCK, BLOCK))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a == b:
            continue
        at, base = order[a:b], k * BLOCK
        s, e = start[at] - base, end[at] - base
        part = data[base : base + int(e.max())]
        for i, number in enumerate(BASES):
            h, down = _prefix(part, number), _powers(number, 2 * BLOCK)[1]
            out[i, at] = _mix((h[e] - h[s]) * down[s])
    return out[0].view(np.int64), out[1].view(np.int64)


def sampled_positions(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(rank of the gram, position, first, last): the windows of ``length`` bytes that choose each position.

    A window chooses the position of its least gram, by hash, the leftmost of equals. The choice depends on the
    window's bytes alone, so equal windows choose alike; first and last are starts of consecutive windows.
    """
    found: list[tuple[np.ndarray, ...]] = []
    width, windows = length - gram + 1, len(data) - length + 1
    for base in range(0, max(0, windows), BLOCK):
        part = data[base : base + min(BLOCK, windows - base) + length - 1]
        h, down = _prefix(part, BASES[0]), _powers(BASES[0], 2 * BLOCK)[1]
        m = len(part) - gram + 1
        name = _mix((h[gram:] - h[:m]) * down[:m])
        pad = -m % width
        key = np.append((name >> np.uint64(POS_BITS) << np.uint64(POS_BITS)) | np.arange(m, dtype=np.uint64), np.full(pad, 2**64 - 1, np.uint64)).reshape(-1, width)
        left = np.minimum.accumulate(key, axis=1).ravel()
        right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        n = m - width + 1
        chosen = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        at = chosen[edge]
        found.append((name[at].view(np.int64), at + base, edge + base, np.append(edge[1:], n) - 1 + base))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    name, at, first, last = (np.concatenate(x) for x in zip(*found))
    same = np.append(False, at[1:] == at[:-1])
    return name[~same], at[~same], first[~same], np.append(last[np.flatnonzero(~same)[1:] - 1], last[-1])


def cell_strings(at, x, size: int, length: int):
    """(core, hull) bounds of a cell: windows that start x to x + size - 1 bytes before position ``at``.

    The core is in each of these windows, the hull holds them all.
    """
    return (at - x, at - x - size + 1 + length), (at - x - size + 1, at - x + length)


def _bytes(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.uint8)


def _named(hashes: tuple[np.ndarray, np.ndarray], *numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each string, joined with small numbers that count as part of it."""
    out = []
    for h in hashes:
        x = h.view(np.uint64)
        for n in numbers:
            x = _mix((x ^ np.asarray(n).astype(np.uint64)) * np.uint64(BASES[1]))
        out.append(x.view(np.int64))
    return out[0], out[1]


def cell_names(data: np.ndarray, at, low, high, lo, size: int, length: int, rid) -> list[np.ndarray]:
    """Cells of ``size`` windows of each position: its row, low, high, and names of the cell's core and hull.

    ``data`` holds the surroundings of all positions end to end, those of row i from data[lo[i, 0]] to
    data[lo[i, 1]], standing for the text from lo[i, 2]. low to high are how far before ``at`` windows start.
    """
    k0 = low // size
    count = high // size - k0 + 1
    row = np.repeat(np.arange(len(at)), count)
    x = (k0[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
    core, hull = cell_strings(at[row], x, size, length)
    shift = (lo[:, 0] - lo[:, 2])[row]
    c = _named(string_hashes(data, core[0] + shift, core[1] + shift), x)
    h = [c[0].copy(), c[1].copy()]
    if size > 1:
        inside = (hull[0] + shift >= lo[row, 0]) & (hull[1] + shift <= lo[row, 1])
        h[0][inside], h[1][inside] = _named(string_hashes(data, (hull[0] + shift)[inside], (hull[1] + shift)[inside]), x[inside])
        # a hull that leaves the text is equal to none
        h[0][~inside], h[1][~inside] = -1 - rid[row][~inside], at[row][~inside] * 1024 + x[~inside]
    return [row, np.maximum(low[row], x), np.minimum(high[row], x + size - 1), *c, *h]


class Repeats:
    """Finds, over all texts, each window of ``length`` bytes that starts anywhere else too.

    made: the rows (rid, row: the caller's columns, digest, n_bytes), written once. spans(): (rid, start, end) of
    repeated bytes. Rows with equal texts of ``length`` bytes or more are repeated throughout; only one of them is sampled.
    """

    def __init__(self, docs: DataFrame, length: int = 400, gram: int = 32, sizes: tuple[int, ...] = (64, 8, 1)):
        # a cell's core must reach past the gram, and the last round looks at single windows
        self.length, self.gram, self.sizes = length, gram, (*(s for s in sizes if 1 < s <= length - gram), 1)
        text = F.coalesce(F.col("text"), F.lit(""))
        # the caller's columns travel in one of their own, so that no name of theirs meets one of ours
        rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
        self.made = cut(rows, "suffix-texts")
        self.text = F.coalesce(F.col("row.text"), F.lit("")).alias("text")

    def positions(self, copies: DataFrame) -> DataFrame:
        """Sampled positions of one row of each text: gram, and a name of all that the position's windows cover; a written table."""
        length, gram = self.length, self.gram
        columns = {"name": "long", "at": "int", "first": "int", "last": "int", "w1": "long", "w2": "long"}

        def sample(batches):
            for b in batches:
                text = b["text"].cast(pa.binary())
                parts = []
                for i in range(len(text)):
                    data = _bytes(text, i)
                    name, at, first, last = sampled_positions(data, length, gram)
                    parts.append((name, at, first, last, *_named(string_hashes(data, first, last + length), at - first, last - at)))
                offsets = pa.array(np.cumsum([0, *(len(p[0]) for p in parts)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()).cast(pa.int32() if kind == "int" else pa.int64())) for k, kind in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([b["rid"], *lists], names=["rid", *columns])

        texts = self.made.where(F.col("n_bytes") >= length).select("rid", self.text)
        found = texts.mapInArrow(sample, "rid long, " + ", ".join(f"{c} array<{kind}>" for c, kind in columns.items()))
        found = found.join(copies.select("rid"), "rid", "left_semi")
        return cut(found.select("rid", F.inline(F.arrays_zip(*columns))), "suffix-positions")

    def surroundings(self, live: DataFrame) -> DataFrame:
        """For positions (rid, at, first, last): low, high, and the bytes around them from ``lo`` on; a written table."""
        length, margin = self.length, max(self.sizes) - 1
        listed = live.groupBy("rid").agg(F.collect_list(F.struct("at", "first", "last")).alias("places"))
        rows = self.made.select("rid", self.text).join(listed, "rid")

        def around(batches):
            for b in batches:
                text, lists = b["text"].cast(pa.binary()), b["places"]
                bounds, value = lists.offsets.to_numpy(), lists.values
                at, first, last = (value.field(k).to_numpy() for k in ("at", "first", "last"))
                for i in range(len(text)):
                    data, rid = text[i].as_buffer(), b["rid"][i].as_py()
                    for s in range(bounds[i], bounds[i + 1], 2000):
                        p = slice(s, min(s + 2000, bounds[i + 1]))
                        lo, hi = np.maximum(first[p] - margin, 0), np.minimum(last[p] + length + margin, len(data))
                        near = [data[x:y].to_pybytes() for x, y in zip(lo.tolist(), hi.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), rid)), pa.array(at[p]), pa.array(at[p] - last[p]), pa.array(at[p] - first[p]), pa.array(lo), pa.array(near, pa.binary())], names=["rid", "at", "low", "high", "lo", "near"])

        return cut(rows.mapInArrow(around, "rid long, at int, low int, high int, lo int, near binary"), "suffix-near")

    def hashed(self, cells: DataFrame, size: int) -> DataFrame:
        """(rid, at, low, high, c1, c2, h1, h2) of the cells of ``size`` windows of (rid, at, low, high, lo, near); a written table."""
        length = self.length

        def name(batches):
            for whole in batches:
                for s in range(0, whole.num_rows, 1000):
                    b = whole.slice(s, 1000)
                    near = b["near"].to_pylist()
                    ends = np.cumsum([0, *map(len, near)])
                    rid, at, low, high, start = (b[c].to_numpy().astype(np.int64) for c in ("rid", "at", "low", "high", "lo"))
                    row, low, high, *names = cell_names(np.frombuffer(b"".join(near), np.uint8), at, low, high, np.column_stack([ends[:-1], ends[1:], start]), size, length, rid)
                    small = [pa.array(c, pa.int64()).cast(pa.int32()) for c in (at[row], low, high)]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[row]), *small, *map(pa.array, names)], names=["rid", "at", "low", "high", "c1", "c2", "h1", "h2"])

        rows = cells.select("rid", "at", "low", "high", "lo", "near")
        return cut(rows.mapInArrow(name, "rid long, at int, low int, high int, c1 long, c2 long, h1 long, h2 long"), f"suffix-rank-{size}")

    def spans(self) -> DataFrame:
        """(rid, start, end) of repeated bytes, as a written table that lists them by rid.

        First, positions whose windows cover equal strings throughout are done: all repeat, and one stays as a witness
        as long as the gram stands in other surroundings too. Then, round by round, the windows of a position are split
        into smaller cells, so that the string that a cell's windows have in common (core) grows towards ``length``.
        A cell whose core is unique is done: none of its windows repeats. A cell whose hull, all that its windows
        cover, repeats is done too: all do. One cell of each hull stays as long as others share its core.

        Each aggregate is written before it is joined: a join straight after its own aggregate would keep the
        aggregate's partitions, and could not split a hot name.
        """
        copies = cut(self.made.groupBy("digest").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")), "suffix-classes")
        whole = self.made.where(F.col("n_bytes") >= self.length).select("rid", "digest", "n_bytes").join(copies.where("copies > 1").select("digest").hint("merge"), "digest")
        spans = [cut(whole.select("rid", F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")), "suffix-whole")]
        flat = self.positions(copies)
        drop(copies)
        shared = cut(flat.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "suffix-shared")
        kept = cut(flat.join(shared.hint("merge"), "name"), "suffix-kept")
        drop(flat, shared)
        equal = cut(kept.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at", "first", "last", "name")).alias("one")), "suffix-equal")
        hit = kept.join(equal.where("n > 1").select("w1", "w2").hint("merge"), ["w1", "w2"])
        spans.append(cut(hit.select("rid", F.col("first").alias("start"), (F.col("last") + self.length).alias("end")), "suffix-spans"))
        several = cut(equal.groupBy(F.col("one.name").alias("name")).agg(F.count("*").alias("n")).where("n > 1").select("name"), "suffix-several")
        live = equal.select("one.*").join(several.hint("merge"), "name")
        near = self.surroundings(live.select("rid", "at", "first", "last"))
        drop(kept, equal, several)
        cells = near
        for size in self.sizes:
            ranked = self.hashed(cells, size)
            core, hull = ["c1", "c2"], ["h1", "h2"]
            one = F.min(F.struct("rid", "at", "low", "high", *core)).alias("one")
            by_hull = cut(ranked.groupBy(*hull).agg(F.count("*").alias("n"), one), "suffix-hulls")
            hit = ranked.join(by_hull.where("n > 1").select(*hull).hint("merge"), hull)
            spans.append(cut(hit.select("rid", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + self.length).alias("end")), "suffix-spans"))
            drop(ranked)
            if size > 1:
                total = cut(by_hull.select("one.*").groupBy(*core).agg(F.count("*").alias("hulls")).where("hulls > 1").select(*core), "suffix-cores")
                rest = by_hull.select("one.*").join(total.hint("merge"), core).select("rid", "at", "low", "high")
                rest = cut(rest, "suffix-rest")
                drop(by_hull, total)
                cells = rest.join(near.select("rid", "at", "lo", "near"), ["rid", "at"])
            else:
                drop(by_hull)
        every = spans[0]
        for more in spans[1:]:
            every = every.union(more)
        listed = cut(every.groupBy("rid").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end")), "suffix-listed")
        drop(near, *spans)
        return listed


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered; runs that touch are one."""
    out: list[list[int]] = []
    for i in np.argsort(start, kind="stable"):
        if out and start[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(end[i]))
        else:
            out.append([int(start[i]), int(end[i])])
    return [(a, b) for a, b in out]


def remaining_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join(out) + data[at:]


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 32) -> DataFrame:
    """``docs(doc_id, text, ...)`` with every byte found that a repeated string of ``length`` bytes covers.

    Adds n_bytes, n_removed, n_spans (maximal removed runs), kept_bytes, kept_text (whole characters of these) and
    kept_sha256, in place of columns so named; all other columns stay as they are, ``text`` among them.
    Strings are compared as UTF-8 bytes within and across rows, judged on the input. Null texts count as empty;
    texts shorter than ``length`` keep all. Rows with equal texts of that length lose all of it. Repeated rows
    and repeated or null doc_ids are fine: one row out for each row in. No rows give an empty result.
    """
    added = {"n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_text", "kept_sha256"}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))
    repeats = Repeats(docs, length, gram)
    listed = repeats.spans()

    @F.pandas_udf("n_removed long, n_spans long, kept_bytes binary, kept_text string, kept_sha256 string")
    def strip(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, z in zip(text, start, end):
            if t is None:
                out.append((None,) * 5)
                continue
            runs = merged(a, z)
            kept = remaining_bytes(t.encode("utf-8", "surrogatepass"), runs)
            out.append((sum(y - x for x, y in runs), len(runs), kept, kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_bytes", "kept_text", "kept_sha256"])

    rows = repeats.made.select("rid", "row", "digest", "n_bytes", repeats.text).join(listed, "rid", "left")
    rows = rows.withColumn("done", strip(F.when(F.col("start").isNotNull(), F.col("text")), "start", "end"))
    zero = F.lit(0).cast("long")
    return rows.select(
        "row.*",
        "n_bytes",
        F.coalesce("done.n_removed", zero).alias("n_removed"),
        F.coalesce("done.n_spans", zero).alias("n_spans"),
        F.coalesce("done.kept_bytes", F.col("text").cast("binary")).alias("kept_bytes"),
        F.coalesce("done.kept_text", "text").alias("kept_text"),
        F.coalesce("done.kept_sha256", "digest").alias("kept_sha256"),
    )


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``text``: what is left of each text, in whole characters."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))
