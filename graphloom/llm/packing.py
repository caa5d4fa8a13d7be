"""Packing of token sequences: length patterns fitted by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import rank_encoder
from .common import cut, slices, table

#: Vocabulary for ``tokenizers``, the same vocabulary as ranks, and its special strings.
VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", (("<|endoftext|>", 50256),))
#: The last code point of which both libraries are known to make the same ids (see tests/llm/test_tokens.py).
SAME_UP_TO = "ɏ"
BEYOND = re.compile(f"[^\\0-{SAME_UP_TO}]")


@lru_cache(maxsize=2)
def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_texts(texts: list[str], end: int) -> list[bytes]:
    """Ids of each text and the end id, as ``tokenizers`` gives them without added special tokens."""
    json, ranks, special = VOCABULARY
    out: list[bytes | None] = [None] * len(texts)
    same = []
    for i, text in enumerate(texts):
        if text.isascii() or not BEYOND.search(text):
            same.append(i)
        else:
            out[i] = np.array(_library(public_tokenizers.path(json)).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for i, ids in zip(same, rank_encoder(public_tokenizers.path(ranks), special).encode_all([texts[i] for i in same])):
        out[i] = ids
    last = np.array([end], "<u4").tobytes()
    return [ids + last for ids in out]


def encode_text(text: str, end: int) -> bytes:
    """``encode_texts`` of one text."""
    return encode_texts([text], end)[0]


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first takes what full pieces leave over."""
    first = n % size or size
    return [(0, min(first, n))] + [(at, size) for at in range(first, n, size)]


def exact_patterns(counts: dict[int, int], size: int, parts: int, most: int = 6000) -> list[tuple[int, ...]]:
    """Patterns of up to ``parts`` (two or three) lengths that fill a sequence exactly: all of one and two, about ``most`` of three.

    Those of three are built from the commonest lengths on, and thinned evenly once there are more than ``most``.
    """
    found = [(size,)] if size in counts else []
    found += [(a, size - a) for a in sorted(counts) if a <= size - a and size - a in counts]
    if parts < 3:
        return found
    common = sorted(counts, key=lambda x: (-counts[x], x))
    triples: set[tuple[int, ...]] = set()
    for a in common:
        triples |= {(a, b, size - a - b) for b in common if a <= b <= size - a - b and size - a - b in counts}
        if len(triples) >= most:
            break
    return found + sorted(triples)[:: max(1, len(triples) // most)]


def filling_patterns(counts: dict[int, int], size: int, above: float, each: tuple[int, ...] = (6, 3), kept: int = 3) -> list[tuple[int, ...]]:
    """Patterns around each length over ``above``, as the largest: those of one and two more that leave least of the sequence.

    ``each`` says how many of each kind; sums of two lengths are looked up, with ``kept`` ways to each.
    """
    lengths = sorted(counts)
    room = size - min((x for x in lengths if x > above), default=size)
    sums: list[dict[int, list[tuple[int, ...]]]] = [{x: [(x,)] for x in lengths}]
    for _ in range(len(each) - 1):
        found: dict[int, list[tuple[int, ...]]] = {}
        for x in lengths:
            for total, ways in sums[-1].items():
                if total + x <= room:
                    own = found.setdefault(total + x, [])
                    own += [(*w, x) for w in ways if x >= w[-1]][: kept - len(own)]
        sums.append(found)
    out = set()
    for largest in (x for x in lengths if x > above):
        for ways, most in zip(sums, each):
            got = 0
            for total in range(size - largest, 0, -1):
                for w in ways.get(total, ()):
                    p = tuple(sorted((*w, largest)))
                    if got < most and all(p.count(x) <= counts[x] for x in p):
                        out.add(p)
                        got += 1
                if got >= most:
                    break
    return sorted(out)


def fit_patterns(counts: dict[int, int], patterns: list[tuple[int, ...]], size: int, sweeps: int = 20, waste: float = 0.0, parts: float = 0.0) -> list[float]:
    """Repeat counts n >= 0 of ``patterns`` by non-negative least squares: min |A n - h|**2 / 2 + c n, by coordinate descent.

    h is the histogram, A the uses of each length by each pattern, and c what a pattern costs: ``waste`` times the share of
    the sequence that it leaves, and ``parts`` for each length beyond two, as small ones are wanted elsewhere.
    """
    at = {x: i for i, x in enumerate(sorted(counts))}
    left = np.array([float(counts[x]) for x in at])
    uses = [(np.array([at[x] for x in u]), np.array(list(u.values()), float)) for u in map(Counter, patterns)]
    norm = [float(w @ w) for _, w in uses]
    cost = [waste * (size - sum(p)) / size + parts * (len(p) - 2) for p in patterns]
    n = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, (x, w) in enumerate(uses):
            new = max(0.0, n[i] + (float(w @ left[x]) - cost[i]) / norm[i])
            if d := new - n[i]:
                n[i] = new
                moved += abs(d)
                left[x] -= w * d
        if moved < 0.5:
            break
    return n


def _take(plan: Counter, spare: Counter, patterns: list[tuple[int, ...]], wanted: list[int], order: list[int]) -> int:
    """Move what ``spare`` has of the ``wanted`` counts to ``plan``, in ``order``; how many that is."""
    taken = 0
    for i in order:
        u = Counter(patterns[i])
        k = min([wanted[i], *(spare[x] // m for x, m in u.items())])
        if k > 0:
            plan[patterns[i]] += k
            taken += k
            for x, m in u.items():
                spare[x] -= k * m
    return taken


def fitted_plan(counts: dict[int, int], size: int, parts: int, stages: tuple[float, ...], back: float = 0.05) -> tuple[Counter, Counter]:
    """(patterns with their counts, the histogram they leave).

    The first fit is over patterns of up to ``parts`` lengths that fill a sequence exactly, rounded down. Then, for each of ``stages``, patterns are
    made anew for what is left, around lengths over that share of a sequence; their fitted counts are rounded down, and then
    up by largest remainders as far as the histogram goes, until a fit takes nothing more. Rounding up leaves some sequences
    poorly filled: of those of several pieces the least full, a share ``back`` of them, go back.
    """
    plan, spare = Counter(), Counter(counts)
    exact = exact_patterns(counts, size, parts)
    n = fit_patterns(counts, exact, size)
    _take(plan, spare, exact, [int(x + 1e-9) for x in n], sorted(range(len(n)), key=lambda i: (-n[i], exact[i])))
    for share in stages:
        while True:
            spare = +spare
            patterns = filling_patterns(spare, size, share * size)
            n = fit_patterns(spare, patterns, size, waste=2.0, parts=0.2)
            rank = lambda v, patterns=patterns: sorted(range(len(v)), key=lambda i: (-v[i], size - sum(patterns[i]), patterns[i]))
            rest = [x % 1 for x in n]
            taken = _take(plan, spare, patterns, [int(x + 1e-9) for x in n], rank(n))
            taken += _take(plan, spare, patterns, [int(x >= 0.02) for x in rest], rank(rest))
            if not taken:
                break
    few = int(back * sum(k for p, k in plan.items() if len(p) > 1))
    for p in sorted((p for p in plan if len(p) > 1), key=lambda p: (sum(p), -len(p), p)):
        k = min(plan[p], few)
        plan[p] -= k
        few -= k
        for x in p:
            spare[x] += k
    return +plan, +spare


def best_fit(counts: dict[int, int], size: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over a histogram: equal sequences are filled together, whatever their number."""
    room: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = min((r for r in room if r >= length), default=None)
            if at is None:
                k = min(todo, todo // (size // length) or 1)
                per = min(size // length, todo)
                room.setdefault(size - length * per, Counter())[(length,) * per] += k
                todo -= k * per
                continue
            content, n = next(iter(room[at].items()))
            k = min(n, todo)
            room[at][content] -= k
            if not room[at][content]:
                del room[at][content]
            if not room[at]:
                del room[at]
            room.setdefault(at - length, Counter())[content + (length,)] += k
            todo -= k
    return dict(sum(room.values(), Counter()))


#: Parts of the exact patterns, and the least shares of a sequence that the largest length of later patterns has, one stage after
#: the other, and the share that goes back. Plentiful lengths pack best if only large ones are matched, scarce ones if all are,
#: in few or many bands.
SCHEDULES = ((3, (0.5,), 0.02), (2, (0.75, 0.5, 0.0), 0.05), (2, (*(i / 20 for i in range(19, 9, -1)), 0.3, 0.0), 0.05))


def plan(counts: dict[int, int], size: int) -> dict[tuple[int, ...], int]:
    """Patterns and repeat counts that use up the histogram: fitted patterns, and best fit of what they leave.

    Made once with each of SCHEDULES, of which the one with fewest sequences is taken, among equals that with most fitted.
    Best fit gets the residual alone: what the fits left, and what their rounding gave back.
    """
    made = []
    for schedule in SCHEDULES:
        fitted, rest = fitted_plan(counts, size, *schedule)
        made.append((fitted + Counter(best_fit(rest, size)), fitted.total()))
    return dict(min(made, key=lambda m: (m[0].total(), -m[1]))[0])


def slots(patterns: dict[tuple[int, ...], int]) -> pd.DataFrame:
    """For each length, which of its pieces (numbered from 0) go where: length, first, last, sequence, offset."""
    used, sequence, out = Counter(), 0, []
    for p, k in sorted(patterns.items()):
        offset = 0
        for x in p:
            out.append((x, used[x], used[x] + k, sequence, offset))
            used[x] += k
            offset += x
        sequence += k
    return pd.DataFrame(out, columns=["length", "first", "last", "sequence", "offset"]).astype("int64").sort_values(["length", "first"])


def pack_documents(docs: DataFrame, size: int = 1024, end: int = 2) -> DataFrame:
    """Packs every text of ``docs(doc_id, text)``, with the id ``end`` after it, into sequences of ``size`` ids.

    Longer documents are cut into full pieces behind a shorter first one. Only the histogram of piece lengths
    (``size`` counts at most) reaches the driver, which plans patterns; pieces are then numbered within their
    length, in hashed buckets so that a common length is many groups, and look up their place in the plan.

    Null texts are empty: one piece that holds the end id. One document's pieces for each row in, also for repeated
    rows and null doc_ids; other columns are ignored; no rows give an empty result.
    Returns doc_id, piece int, start, length, ids_crc32, sequence_id, offset (all long).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches):
        for pdf in batches:
            for s in slices(pdf.text):
                out = []
                for doc, ids in zip(pdf.doc_id[s], encode_texts(pdf.text[s].tolist(), end)):
                    out += [(doc, i, a, n, zlib.crc32(memoryview(ids)[4 * a : 4 * (a + n)])) for i, (a, n) in enumerate(cut_points(len(ids) // 4, size))]
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = text.mapInPandas(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    # repeated rows differ in their row number alone, which is written with them
    made = cut(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    buckets = F.pmod(F.xxhash64("row"), F.lit(max(64, made.count() // 50_000)))
    dealt = made.withColumn("bucket", buckets)
    held = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = slots(plan(counts, size)) if counts else slots({})
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select("length", "bucket", before.alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("row")) - 1
    numbered = dealt.withColumn("within", within).join(held, ["length", "bucket"])
    numbered = numbered.select(*(c for c in made.columns if c != "row"), (F.col("within") + F.col("before")).alias("rank"))
    wide = 1 << 40
    starts, columns = (place.length * wide + place["first"]).to_numpy(), place[["first", "sequence", "offset"]].to_numpy()

    def lookup(batches):
        for pdf in batches:
            at = np.searchsorted(starts, (pdf.length * wide + pdf["rank"]).to_numpy(), side="right") - 1
            first, sequence, offset = columns[at].T
            yield pdf.drop(columns="rank").assign(sequence_id=sequence + pdf["rank"].to_numpy() - first, offset=offset)

    return numbered.mapInPandas(lookup, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
