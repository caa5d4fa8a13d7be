"""Vectors as short codes: each part of a vector by the number of the nearest entry of that part's codebook."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table
from .vectors import whole_matrix, whole_vectors

#: Scaled components are held within this on either side: a part's squared distances and their sum over parts fit 64 bits
#: for vectors of up to 32 components a part.
LIMIT = 2.0**27


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry of ``book`` nearest to each row of x, in whole numbers; ties go to the first."""
    entry = np.zeros(len(x), np.int64)
    least = ((x - book[0]) ** 2).sum(axis=1)
    for i in range(1, len(book)):
        d = ((x - book[i]) ** 2).sum(axis=1)
        less = d < least
        entry[less], least[less] = i, d[less]
    return entry, least


def _by_part(batch: pa.RecordBatch):
    """(dim, part, row numbers, matrix) of the rows of each length and part position in a batch."""
    dim, part = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "part"))
    for key in np.unique(np.stack([dim, part]), axis=1).T:
        at = np.flatnonzero((dim == key[0]) & (part == key[1]))
        yield int(key[0]), int(key[1]), at, whole_matrix(batch.column("piece").take(pa.array(at)))


def first_books(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors of length ``dim`` with the least ids, (parts, entries, width); of one id's vectors the least."""
    own = rows.where((F.col("dim") == dim) & F.col("vec_id").isNotNull())
    ids = [r.vec_id for r in own.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return None
    seeds = own.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    return np.array([r.x for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)


def moved(distinct: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks after one round: each entry becomes the floored weighted mean of the distinct parts nearest to it.

    A task sums what it has by entry; those sums are added on Spark, and as many numbers as the books hold reach the driver.
    """

    def sums(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            weight = b.column("weight").to_numpy(zero_copy_only=False)
            for dim, part, at, x in _by_part(b):
                entry, _ = nearest(x, books[dim][part])
                # the last column is the weight itself
                own = total.setdefault((dim, part), np.zeros((books[dim].shape[1], x.shape[1] + 1), np.int64))
                np.add.at(own, entry, np.column_stack([x, np.ones(len(x), np.int64)]) * weight[at, None])
        out = [(d, p, e, s.tolist()) for (d, p), own in total.items() for e, s in enumerate(own) if s[-1]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["dim", "part", "entry", "sums"])

    found = distinct.mapInArrow(sums, "dim int, part int, entry int, sums array<long>")
    found = found.select("dim", "part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    added: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in found.toLocalIterator():
        added.setdefault((r.dim, r.part, r.entry), {})[r["at"]] = int(r.v)
    out = {dim: book.copy() for dim, book in books.items()}
    for (dim, part, entry), v in added.items():
        n = v.pop(len(v) - 1)
        out[dim][part, entry] = [v[i] // n for i in range(len(v))]
    return out


def code_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Codes ``vectors(vec_id, embedding, label)`` by ``parts`` codebooks of ``entries`` entries, all in whole numbers.

    Components become floor(scale * x). Equal parts of one position are folded into distinct rows with weights, which is
    what the ``rounds`` of Lloyd's algorithm run over; the books, parts x entries x width numbers, are all that the driver
    holds. The last assignment gives each distinct part its entry and error, and is joined back to the vectors by the part
    itself. A part that very many vectors share is one distinct row, and Spark splits its side of that join.

    Rows whose vector is null, empty, or holds null or non-finite components drop out, and so do those whose length is no
    multiple of ``parts``. Vectors of different length have codebooks of their own. Books start from the least distinct
    vec_ids (of several vectors with one id, from the least vector); with fewer ids than entries they are shorter. Rows
    without vec_id are coded but start nothing; where no row of a length has an id, that length drops out. Repeated
    rows count and are returned as often as they stand there. Scaled components beyond 2**27 are held there. No rows give an
    empty result; other columns are ignored. A label's error that exceeds 64 bits is null.
    Returns vec_id, code string, error long, label_error long, codebooks_sha256 string.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    rows = whole_vectors(vectors, scale, LIMIT, F.col("vec_id").cast("long").alias("vec_id"), "label").withColumn("dim", F.size("x"))
    rows = cut(rows.where(F.col("dim") % parts == 0).withColumn("rid", F.monotonically_increasing_id()), "code-rows")
    width = F.col("dim") / parts
    piece = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("x", (i * width + 1).cast("int"), width.cast("int")))
    books: dict[int, np.ndarray] = {}
    for r in rows.select("dim").distinct().collect():
        if (book := first_books(rows, r.dim, parts, entries)) is not None:
            books[r.dim] = book
    coded_dims = rows.where(F.col("dim").isin([*books, -1]))
    pieces = coded_dims.select("rid", "vec_id", "label", "dim", F.posexplode(piece).alias("part", "piece"))
    distinct = cut(pieces.groupBy("dim", "part", "piece").agg(F.count("*").alias("weight")), "code-parts")
    for _ in range(rounds):
        before, books = books, moved(distinct, books)
        if all(np.array_equal(before[d], books[d]) for d in books):
            break

    def assign(batches):
        for b in batches:
            entry, error = np.zeros((2, b.num_rows), np.int64)
            for dim, part, at, x in _by_part(b):
                entry[at], error[at] = nearest(x, books[dim][part])
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("part"), b.column("piece"), pa.array(entry), pa.array(error)], names=["dim", "part", "piece", "entry", "error"])

    assigned = distinct.select("dim", "part", "piece").mapInArrow(assign, "dim int, part int, piece array<long>, entry long, error long")
    each = pieces.join(assigned, ["dim", "part", "piece"])
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda e: F.lower(F.lpad(F.hex(e["entry"]), 2, "0"))), "")
    coded = each.groupBy("rid").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("dim").alias("dim"), code.alias("code"), F.sum("error").alias("error"))
    coded = cut(coded, "codes")
    drop(rows, distinct)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.expr("try_sum(error)").alias("label_error"))
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, F.lit(hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest())).otherwise(digest)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one after the other; every book is rows of (part, entry, position, value)."""
    out = f"""WITH ok AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT rid, part, list_slice(x, part * len(x) // {parts} + 1, (part + 1) * len(x) // {parts}) AS piece FROM ok, range({parts}) t(part)),
w AS MATERIALIZED (SELECT part, piece, count(*) AS weight FROM pieces GROUP BY ALL),
c AS MATERIALIZED (SELECT row_number() OVER () AS cell, part, piece, weight FROM w),
z AS MATERIALIZED (SELECT cell, part, weight, generate_subscripts(piece, 1) AS place, unnest(piece) AS v FROM c),
seed AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT rid, vec_id FROM ok WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {entries})),
b0 AS MATERIALIZED (SELECT part, entry, generate_subscripts(piece, 1) AS place, unnest(piece) AS v FROM pieces JOIN seed USING (rid))"""
    for i in range(rounds + 1):
        out += f""",
d{i} AS MATERIALIZED (SELECT cell, z.part, entry, sum((z.v - b.v) * (z.v - b.v))::BIGINT AS error FROM z JOIN b{i} b ON z.part = b.part AND z.place = b.place GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT cell, part, arg_min(entry, (error, entry)) AS entry, min(error) AS error FROM d{i} GROUP BY ALL)"""
        if i < rounds:
            out += f""",
s{i} AS MATERIALIZED (SELECT z.part, a.entry, place, sum(v * weight)::HUGEINT AS s, sum(weight)::HUGEINT AS n FROM z JOIN a{i} a USING (cell) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, b.v)::BIGINT AS v FROM b{i} b LEFT JOIN s{i} s ON s.part = b.part AND s.entry = b.entry AND s.place = b.place)"""
    return f"""{out},
coded AS (SELECT p.rid, string_agg(lpad(printf('%x', a.entry), 2, '0'), '' ORDER BY p.part) AS code, sum(a.error)::BIGINT AS error
  FROM pieces p JOIN c ON c.part = p.part AND c.piece = p.piece JOIN a{rounds} a ON a.cell = c.cell GROUP BY p.rid),
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM ok JOIN coded USING (rid), book"""


ORACLE_SQL = {"op11_vector_codes": _sql()}
