"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, verification on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, connected_components, cut, drop, slices, table

#: Pairs of one class that meet in a task.
HUB = 256
#: Counters that tell frequent shingles from rare ones: a bound on what every task is sent, whatever the data.
COUNTERS = 1 << 16


@dataclass(frozen=True)
class Sketch:
    """Registers are grouped in bands of ``rows``; base and rate space the truncated minima."""

    bands: int = 28
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    top: int = 65_534

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20_240)
        return rng.integers(0, 2**63, self.registers, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, self.registers, np.uint64)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


WORD_HASH = Memo(lambda w: xxhash.xxh64_intdigest(w), 300_000)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of the distinct runs of ``size`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch_all(sets: list[np.ndarray], sketch: Sketch) -> np.ndarray:
    """(documents, registers) of 16-bit registers: floor(1 - log_base of the least exponential variate), truncated."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), sketch.registers), np.uint16)
    if not full:
        return out
    mul, add = sketch.factors()
    least = np.empty((len(full), sketch.registers), np.uint64)
    group, size, first = [], 0, 0
    for at, i in enumerate([*full, None]):
        if i is None or size and size + len(sets[i]) > 60_000:
            x = np.concatenate(group)
            starts = np.cumsum([0, *(len(g) for g in group[:-1])])
            y = np.empty_like(x)
            for r in range(sketch.registers):
                np.multiply(x, mul[r], out=y)
                np.add(y, add[r], out=y)
                least[first : first + len(group), r] = np.minimum.reduceat(y, starts)
            group, size, first = [], 0, at
        if i is not None:
            group.append(sets[i])
            size += len(sets[i])
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    level = np.floor(1 - np.log(-np.log1p(-u) / sketch.rate) / np.log(sketch.base))
    out[full] = np.clip(level, 0, sketch.top + 1).astype(np.uint16)
    return out


def joint_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of row pairs of registers, given the set sizes.

    The counts of greater, smaller and equal registers are trinomial with probabilities that depend on the
    similarity alone once the sizes are known; the likelihood is maximised over a grid.
    """
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    base = sketch.base

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    up, down = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
    best = (more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))).argmax(axis=1)
    return np.take_along_axis(j, best[:, None], axis=1)[:, 0]


def shared_shingles(a: list[bytes], b: list[bytes], size: int) -> tuple[int, int]:
    """(intersection, union) of the two shingle sets, exact: words are numbered, runs of numbers compared."""
    number: dict[bytes, int] = {}
    sets = []
    for words in (a, b):
        ids = np.array([number.setdefault(w, len(number) + 1) for w in words], np.int64)
        k = min(size, len(ids))
        sets.append(np.stack([ids[i : len(ids) - k + 1 + i] for i in range(k)] + [np.zeros(len(ids) - k + 1, np.int64)] * (size - k), axis=1))
    bits = max(1, len(number).bit_length())
    if bits * size <= 63:
        flat = [np.unique((s << (bits * np.arange(size))[None, :]).sum(axis=1)) for s in sets]
        both = len(np.intersect1d(*flat, assume_unique=True))
        return both, len(flat[0]) + len(flat[1]) - both
    x, y = (set(map(tuple, s.tolist())) for s in sets)
    return len(x & y), len(x | y)


def near_duplicate_rows(docs: DataFrame, size: int, percent: int, sketch: Sketch = Sketch(), block: int = 256, pivots: int = 2) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with n_shingles, component_id and first, in place of columns so named.

    Links texts with 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles.
    Equal word sequences fold into classes. A class's bands are looked up in buckets; each member is compared
    with its bucket's first class by likelihood of the registers, then on the full sets. Then buckets that are still
    in several components take ``pivots`` more classes as pivots, which costs that many times as many rows as they have members
    and joins most of what belongs together. What is left is compared in full where two classes share a rare shingle
    (``rooms_of``, which loses no pair), by blocks of about ``block`` classes: blocks of one component are not paired with each other, a pair meets in the first band it shares, passes the
    registers, and is counted on 64-bit hashes of its full sets; only links that join components leave the task, to be
    confirmed on the texts. So no bucket is ever capped or held in one task, and ``block`` and ``pivots`` change costs alone.
    A pair at the limit is missed with probability (1 - (percent/100)**rows)**bands.

    Texts that are null or hold no word have n_shingles 0 and link with nothing; fewer than ``size`` words are one
    shingle. Ties, repeated rows and repeated or null doc_ids are fine. A component is named by its least non-null
    doc_id, and ``first`` marks one row of it (least doc_id, then any one). No rows give an empty result.
    """
    added = {"n_shingles", "component_id", "first"}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))

    @F.pandas_udf("digest binary, n long, regs binary")
    def describe(text: pd.Series) -> pd.DataFrame:
        digest, count, regs = [], [], []
        for s in slices(text):
            words = [words_of(t) if t is not None else [] for t in text[s]]
            sets = [shingle_hashes(w, size) for w in words]
            digest += [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]
            count += map(len, sets)
            regs += [r.tobytes() if len(x) else None for r, x in zip(sketch_all(sets, sketch), sets)]
        return pd.DataFrame({"digest": digest, "n": count, "regs": regs})

    # the caller's columns travel in one of their own, so that no name of theirs meets one of ours
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.struct(*docs.columns).alias("row"), describe("text").alias("d"))
    made = cut(rows.select("rid", "doc_id", "row", F.col("d.digest").alias("digest"), F.col("d.n").alias("n_shingles"), F.col("d.regs").alias("regs")), "shingles")
    classes = made.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("cid"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    classes = cut(classes, "classes")

    def band_keys(batches):
        for pdf in batches:
            regs = np.frombuffer(b"".join(pdf.regs), np.uint16).reshape(len(pdf), sketch.bands, sketch.rows).astype(np.uint64)
            key = np.full(regs.shape[:2], 1, np.uint64) * np.arange(1, sketch.bands + 1, dtype=np.uint64)
            for r in range(sketch.rows):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
            band = np.tile(np.arange(sketch.bands, dtype=np.int32), len(pdf))
            yield pd.DataFrame({"key": key.view(np.int64).ravel(), "band": band, "cid": np.repeat(pdf.cid.to_numpy(), sketch.bands)})

    bands = classes.select("cid", "regs").mapInPandas(band_keys, "key long, band int, cid long")
    buckets = bands.groupBy("key").agg(F.min("cid").alias("first"), F.count("*").alias("members")).where("members > 1")
    # written first, or the join would keep the aggregate's partitions and could not split a hot bucket
    buckets = cut(buckets, "buckets")
    # buckets grow with the texts, so neither side is ever small enough to send to every task
    shared = cut(bands.join(buckets.hint("merge"), "key"), "bands")
    drop(buckets)
    needed = shared.select("cid").distinct()
    texts = cut(made.select(F.col("rid").alias("cid"), F.col("row.text").alias("text")).join(needed, "cid", "left_semi"), "near-texts")
    stars = shared.where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"), "members")
    links = [verified(likely(stars, classes, percent, sketch), texts, size, percent)]
    roots = contracted(links)
    if pivots:
        member = members_of(shared, roots)
        links.append(verified(likely(pivot_pairs(member, pivots), classes, percent, sketch), texts, size, percent))
        drop(member)
        if not links[-1].isEmpty():
            drop(roots)
            roots = contracted(links)
    links.append(verified(remaining(shared, roots, classes, texts, size, percent, sketch, block), texts, size, percent))
    if not links[-1].isEmpty():
        drop(roots)
        roots = contracted(links)
    drop(shared, texts, *links)
    of = classes.select("digest", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("digest", F.coalesce("root", "cid").alias("root"))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("least")
    least = cut(made.where("digest is not null").groupBy("digest").agg(order).join(of, "digest"), "near-least")
    drop(classes, roots)
    name = least.groupBy("root").agg(F.min("least").alias("least"))
    named = cut(least.select("digest", "root").join(name, "root").select("digest", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("first_rid")), "near-named")
    drop(least)
    done = made.select("rid", "row", "digest", "n_shingles", "doc_id").join(named, "digest", "left")
    first_row = F.coalesce(F.col("first_rid") == F.col("rid"), F.lit(True)).alias("first")
    return done.select("row.*", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), first_row)


def minhash_near_dedup(docs: DataFrame, size: int = 3, percent: int = 85, sketch: Sketch = Sketch()) -> DataFrame:
    """doc_id, n_shingles long, component_id, kept boolean of ``docs(doc_id, text)``; see ``near_duplicate_rows``.

    ``kept`` is doc_id = component_id, so rows that repeat one doc_id are all kept; rows without doc_id are kept
    where nothing with a doc_id is linked to them. One row out for each row in; other columns are ignored.
    """
    done = near_duplicate_rows(docs.select("doc_id", "text"), size, percent, sketch)
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return done.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _likely_pairs(a, b, na, nb, percent: int, sketch: Sketch) -> np.ndarray:
    """Pairs whose sizes allow the similarity and whose estimate lies within six deviations of it."""
    t = percent / 100
    slack = 6 * np.sqrt(t * (1 - t) / sketch.registers)
    ok = np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9
    at = np.flatnonzero(ok)
    for s in range(0, len(at), 4096):
        part = at[s : s + 4096]
        ok[part] = joint_similarity(a[part], b[part], na[part], nb[part], sketch) >= t - slack
    return ok


def with_sides(pairs: DataFrame, sides: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b, members) with ``columns`` of both classes, named ..._a and ..._b, from ``sides(cid, ...)``.

    A class that is ``a`` of many pairs is dealt into as many keys as its bucket has blocks of HUB members.
    """
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("b"), F.expr(f"members div {HUB} + 1")))
    hubs = dealt.select("a", "members", "deal").distinct()
    left = hubs.join(sides.select(F.col("cid").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns)), "a")
    right = sides.select(F.col("cid").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return dealt.join(left, ["a", "members", "deal"]).join(right, "b").drop("deal")


def likely(pairs: DataFrame, classes: DataFrame, percent: int, sketch: Sketch) -> DataFrame:
    """The pairs (a, b, members) of classes that their registers let pass, each once, as a written table."""
    pairs = cut(pairs.groupBy("a", "b").agg(F.max("members").alias("members")), "pairs")
    rows = with_sides(pairs, classes, "n", "regs")

    def screen(batches):
        for pdf in batches:
            if len(pdf):
                ra, rb = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), -1) for c in ("regs_a", "regs_b"))
                yield pdf[["a", "b", "members"]][_likely_pairs(ra, rb, pdf.n_a.to_numpy(float), pdf.n_b.to_numpy(float), percent, sketch)]

    passed = cut(rows.select("a", "b", "members", "n_a", "n_b", "regs_a", "regs_b").mapInPandas(screen, "a long, b long, members long"), "likely")
    drop(pairs)
    return passed


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of a written table of pairs (a, b, members), those whose full shingle sets meet the limit, written in its place."""
    rows = with_sides(pairs, texts, "text")

    def check(batches):
        for pdf in batches:
            keep = []
            for ta, tb in zip(pdf.text_a, pdf.text_b):
                both, either = shared_shingles(words_of(ta), words_of(tb), size)
                keep.append(100 * both >= percent * either)
            yield pdf[["a", "b"]][np.array(keep, bool)]

    links = cut(rows.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long"), "links")
    drop(pairs)
    return links


def contracted(links: list[DataFrame]) -> DataFrame:
    """(cid, root) of all classes with a link, as a written table."""
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return connected_components(every.toDF("u", "v"), "near")


def members_of(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets of three and more with their present root, as a written table."""
    roots = roots.withColumnRenamed("node", "cid")
    rows = shared.where("members > 2").join(roots.hint("merge"), "cid", "left")
    return cut(rows.select("key", "band", "cid", "first", "members", F.coalesce("root", "cid").alias("root")), "members")


def pivot_pairs(member: DataFrame, pivots: int) -> DataFrame:
    """Pairs (a, b, members) of up to ``pivots`` classes of each open bucket and members outside their components."""
    orders = [F.xxhash64(F.col("cid"), F.lit(turn)).alias("order") for turn in range(pivots)]
    least = [F.min(F.struct(order, "cid", "root")) for order in orders]
    # one pass for all: a round of its own for each would cost more than the pairs that it saves
    named = F.array_distinct(F.transform(F.array(*least), lambda x: F.struct(x["cid"].alias("a"), x["root"].alias("of"))))
    chosen = member.groupBy("key").agg(named.alias("pivots"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return member.join(chosen.select("key", F.inline("pivots")).hint("merge"), "key").where("root <> of").select("a", F.col("cid").alias("b"), "members")


def groups_of(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Contiguous groups of rows with equal ``by`` in a stream of sorted batches."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = rest[by].to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *edges[:-1]], edges):
            yield rest[a:b]
        rest = rest[edges[-1] :].reset_index(drop=True) if len(edges) else rest
    if rest is not None and len(rest):
        yield rest


def joining_links(cid, root, sets, a, b, percent: int) -> list[tuple[int, int]]:
    """Of the candidate pairs a-b (row numbers), the links that join components of the block."""
    parent = {r: r for r in root.tolist()}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(root[x]), find(root[y])
        if rx == ry:
            continue
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            out.append((cid[x], cid[y]))
            parent[max(rx, ry)] = min(rx, ry)
    return out


def rooms_of(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root): the classes of ``sets(cid, root, set)`` that may link with another component, and a room for each.

    Sets of n <= m shingles whose similarity is t or more share t (n + m) / (1 + t) of them, which is 2 t n / (1 + t) and t m at
    least. So in any order that all sets have in common, one of the first n - ceil(2 t n / (1 + t)) + 1 of the smaller set, its
    head, is among the first m - ceil(t m) + 1 of the larger. Here rare shingles come first: counters, of a fixed number
    whatever the data, say how frequent. Classes of several components that share a shingle there, in a head of one of them, are in
    one room, and so are those that a chain of these joins; a class without one is in none. So classes that are alike in frequent shingles alone
    (pages of one form) meet no more, and rows grow with the sizes of the sets.
    """

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for pdf in batches:
            s = np.frombuffer(b"".join(pdf.set), np.uint64)
            total += np.bincount((s % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        if len(at):
            yield pd.DataFrame({"at": at, "n": total[at]})

    held = sets.select("set").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[held["at"].to_numpy()] = held["n"].to_numpy()
    counts = sets.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches):
        for pdf in batches:
            firsts, heads = [], []
            for raw in pdf.set:
                s = np.frombuffer(raw, np.uint64)
                few = len(s) + 1 - -(-percent * len(s) // 100)
                firsts.append(s[np.lexsort((s, counts.value[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:few]])
                heads.append(np.arange(few) < len(s) + 1 - -(-2 * percent * len(s) // (100 + percent)))
            if firsts:
                own = np.repeat(np.arange(len(pdf)), [len(f) for f in firsts])
                yield pd.DataFrame({"g": np.concatenate(firsts).view(np.int64), "head": np.concatenate(heads), "cid": pdf.cid.to_numpy()[own], "root": pdf.root.to_numpy()[own]})

    rare = cut(sets.select("cid", "root", "set").mapInPandas(rarest, "g long, head boolean, cid long, root long"), "rare")
    met = rare.groupBy("g").agg(F.min("cid").alias("least"), F.max("head").alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("head and lo <> hi")
    # written first, so that the join can split a frequent shingle
    met = cut(met.select("g", "least"), "rare-met")
    rooms = connected_components(rare.join(met.hint("merge"), "g").select(F.col("cid").alias("u"), F.col("least").alias("v")), "rooms")
    drop(rare, met)
    counts.destroy()
    return rooms


def remaining(shared: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, sketch: Sketch, block: int) -> DataFrame:
    """Links (a, b, members) between components of classes that share a bucket and a room, as a written table.

    A room's members in a bucket are dealt into blocks: those of a component of ``block`` members and more have blocks of
    their own, the others pool. Every two blocks meet in a group of their own, but for two of the same component.
    """
    every = members_of(shared, roots)
    several = every.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_members = cut(every.join(several.hint("merge"), "key"), "open-members")
    drop(every)

    @F.pandas_udf("binary")
    def full_set(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(words_of(t), size).tobytes() for t in text])

    wanted = open_members.select("cid", "root").distinct()
    sets = cut(texts.join(wanted.hint("merge"), "cid").select("cid", "root", full_set("text").alias("set")), "near-sets")
    rooms = rooms_of(sets, percent)
    member = cut(open_members.join(rooms.select(F.col("node").alias("cid"), F.col("root").alias("room")).hint("merge"), "cid"), "in-rooms")
    drop(open_members, rooms)
    spot = ["key", "room"]
    held = member.groupBy(*spot, "root").agg(F.count("*").alias("n"))
    open_ = held.groupBy(*spot).agg(F.count("*").alias("roots"), F.coalesce(F.sum(F.when(F.col("n") < block, F.col("n"))), F.lit(0)).alias("pooled")).where("roots > 1")
    held = cut(held.join(open_.hint("merge"), spot), "open-roots")
    # the component that a block belongs to, or -1 for pooled ones, and how many blocks there are of it
    own = F.when(F.col("n") >= block, F.col("root")).otherwise(F.lit(-1)).alias("own")
    parts = F.expr(f"(if(n >= {block}, n, pooled) + {block} - 1) div {block}").alias("parts")
    blocks = cut(held.select(*spot, own, parts).distinct().select(*spot, F.col("own").alias("other"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("other_part")), "blocks")
    placed = cut(member.join(held.select(*spot, "root", own, parts).hint("merge"), [*spot, "root"]), "placed")
    part = F.pmod(F.xxhash64(F.when(F.col("own") < 0, F.col("root")).otherwise(F.col("cid"))), "parts").alias("part")
    rows = placed.select(*spot, "band", "cid", "first", "root", "own", part).join(blocks.hint("merge"), spot).where("own <> other or own = -1")
    ours, others = F.struct(F.col("own").alias("of"), F.col("part")), F.struct(F.col("other").alias("of"), F.col("other_part").alias("part"))
    i, j = F.least(ours, others), F.greatest(ours, others)
    rows = rows.select(*spot, "band", "cid", "first", "root", (ours == i).alias("left"), i.of.alias("iof"), i.part.alias("ipart"), j.of.alias("jof"), j.part.alias("jpart"))
    described = sets.select("cid", "set").join(classes.select("cid", "n", "regs"), "cid")
    by = [*spot, "iof", "ipart", "jof", "jpart"]
    dealt = rows.join(described.hint("merge"), "cid").repartition(*by).sortWithinPartitions(*by)

    def compare(batches):
        for g in groups_of(batches, by):
            if g.root.nunique() < 2:
                continue
            regs = np.frombuffer(b"".join(g.regs), np.uint16).reshape(len(g), -1)
            cid, root, n = g.cid.to_numpy(), g.root.to_numpy(), g.n.to_numpy(float)
            star, left = (g["first"] == g.cid).to_numpy(), g.left.to_numpy()
            hashes = [np.frombuffer(x, np.uint64) for x in g.set]
            if (g.iof.iloc[0], g.ipart.iloc[0]) == (g.jof.iloc[0], g.jpart.iloc[0]):
                a, b = np.nonzero((root[:, None] != root[None, :]) & (cid[:, None] < cid[None, :]))
            else:
                x, y = np.flatnonzero(left), np.flatnonzero(~left)
                a, b = np.nonzero(root[x][:, None] != root[y][None, :])
                a, b = x[a], y[b]
            free = ~star[a] & ~star[b]
            a, b = a[free], b[free]
            before = regs[:, : g.band.iloc[0] * sketch.rows].reshape(len(g), -1, sketch.rows)
            ok = np.zeros(len(a), bool)
            for s in range(0, len(a), 20_000):
                x, y = a[s : s + 20_000], b[s : s + 20_000]
                met = (before[x] == before[y]).all(axis=2).any(axis=1)
                new = np.flatnonzero(~met)
                x, y = x[new], y[new]
                ok[s + new] = _likely_pairs(regs[x], regs[y], n[x], n[y], percent, sketch)
            links = joining_links(cid, root, hashes, a[ok], b[ok], percent)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    found = dealt.mapInPandas(compare, "a long, b long").distinct().withColumn("members", F.lit(0).cast("long"))
    found = cut(found, "remaining")
    drop(member, held, blocks, placed, sets)
    return found


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op6_near_duplicates": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT * FROM x SEMI JOIN f USING (g)) a JOIN (SELECT * FROM x SEMI JOIN f USING (g)) b
    ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.b, s.doc_id) AS component_id, coalesce(c.b, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id
"""
}
