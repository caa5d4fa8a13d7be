"""Byte-level BPE: encoding in overlapping chunks, decoding by concatenation of raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, cut, slices, table

#: A blank or line end that the next pre-token can't simply absorb.
UNEVEN = re.compile(r"[ \n](?:\s|\Z)")


class RankEncoder:
    """Ids of texts by the ranks of one file, as little-endian unsigned 32-bit integers.

    Before a blank or line end that a non-space follows, a text can be cut without any change to its
    pre-tokens: what stands before ends the same with or without the rest. So words are encoded with the
    blank before them and remembered; texts with other runs of white space go to the library whole.
    """

    def __init__(self, path: str, special: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.special = special or {}
        self.after_blank = Memo(lambda w: self.whole(" " + w))
        self.raw = Memo(self.whole)
        self.width = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.width[list(self.ranks.values())] = [len(b) for b in self.ranks]
        self.bytes_of = {i: b for b, i in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}

    def whole(self, text: str) -> bytes:
        return self.library.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        for s, i in self.special.items():
            if s in text:
                return np.array([i], "<u4").tobytes().join(map(self.encode, text.split(s)))
        if not text or text[0] in " \n" or UNEVEN.search(text):
            return self.whole(text)
        out, blank = [], self.after_blank.__getitem__
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            out.append(self.raw[f"\n{words[0]}" if k else words[0]])
            out += map(blank, words[1:])
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; words that begin with a blank or line end are told apart in Arrow, and the distinct ones encoded in one go."""
        out: list[bytes | None] = [None] * len(texts)
        even, heads, tails = [], [], []
        for i, t in enumerate(texts):
            if not t or t[0] in " \n" or any(s in t for s in self.special) or UNEVEN.search(t):
                out[i] = self.encode(t)
                continue
            k = min(len(t) if j < 0 else j for j in (t.find(" "), t.find("\n")))
            even.append(i)
            heads.append(self.raw[t[:k]])
            tails.append(t[k:].encode("utf-8", "surrogatepass"))
        data = np.frombuffer(b"".join(tails), np.uint8)
        if not len(data):
            for i, head in zip(even, heads):
                out[i] = head
            return out
        at = np.append(np.flatnonzero((data == 32) | (data == 10)), len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        which, told = words.indices.to_numpy(), words.dictionary
        bounds = np.frombuffer(told.buffers()[1], np.int64)[: len(told) + 1]
        ids = np.frombuffer(self.whole(told.buffers()[2].slice(0, int(bounds[-1])).to_pybytes().decode("utf-8", "surrogatepass")), "<u4")
        # no id goes from one word into the next
        edges = np.append(0, np.cumsum(self.width[ids]))
        first = np.searchsorted(edges, bounds)
        n = np.diff(first)[which]
        stop = np.cumsum(n)
        ids = ids[np.repeat(first[which] - stop + n, n) + np.arange(stop[-1])].tobytes()
        ends = np.searchsorted(at, np.cumsum([len(t) for t in tails]))
        bounds = (4 * np.append(0, stop)[ends]).tolist()
        for i, head, a, b in zip(even, heads, [0, *bounds], bounds):
            out[i] = head + ids[a:b]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def rank_encoder(path: str, special: tuple[tuple[str, int], ...] = ()) -> RankEncoder:
    return RankEncoder(path, dict(special))


def safe_boundaries(text: str, last: bool) -> np.ndarray:
    """Ends of pre-tokens that end in a non-space, without those that the end of a chunk may have made."""
    import regex

    ends = [m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)]
    return np.array([e for e in ends if (last or e < len(text)) and not text[e - 1].isspace()], np.int64)


def encode_documents(docs: DataFrame, ranks: str, chunk: int = 32_768, overlap: int = 1024) -> DataFrame:
    """Ids and decoded bytes of ``docs(doc_id, text)``: doc_id, ids binary pieces digested per document.

    Texts of up to ``chunk`` characters are one piece. Longer ones are dealt out as chunks that overlap by
    ``overlap`` characters; each chunk is pre-tokenised from its own start, neighbours are stitched at the
    first boundary on which both agree (from there on their pre-tokens are the same), and the pieces between
    stitches are encoded in parallel. Where neighbours agree nowhere in the overlap, it is widened (see ``stitched``).

    Null texts are empty: 0 ids, digests of nothing. One row out for each row in, whatever the doc_ids; other
    columns are ignored; no rows give an empty result.
    Returns doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    digests = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def short(batches):
        encoder = rank_encoder(ranks)
        for pdf in batches:
            for s in slices(pdf.text):
                ids = [encoder.encode(t) for t in pdf.text[s]]
                yield pd.DataFrame({"doc_id": pdf.doc_id[s], "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids], "decoded_sha256": [hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids]})

    one = rows.where(F.length("text") <= chunk).mapInPandas(short, f"doc_id {kind}, {digests}")
    long = cut(rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.length("text").cast("long").alias("size")), "bpe-long")
    pieces = stitched(long, chunk, overlap)

    def encode(batches):
        encoder = rank_encoder(ranks)
        for pdf in batches:
            for s in slices(pdf.piece):
                yield pd.DataFrame({"rid": pdf.rid[s], "i": pdf.i[s], "ids": [encoder.encode(t) for t in pdf.piece[s]]})

    encoded = pieces.mapInPandas(encode, "rid long, i long, ids binary")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder, ids, raw = rank_encoder(ranks), hashlib.sha256(), hashlib.sha256()
        for x in pdf.sort_values("i").ids:
            ids.update(x)
            raw.update(encoder.decode(x))
        return pd.DataFrame({"rid": pdf.rid[:1], "n_tokens": sum(map(len, pdf.ids)) // 4, "ids_sha256": ids.hexdigest(), "decoded_sha256": raw.hexdigest()})

    joined = encoded.groupBy("rid").applyInPandas(join, f"rid long, {digests}")
    return one.union(long.select("rid", "doc_id").join(joined, "rid").select(one.columns))


def stitched(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(rid, i, piece) of ``long(rid, text, size)``: pieces whose pre-tokens are those of the whole text.

    Texts some of whose chunks agree nowhere are dealt out again with overlaps of eight times the width, up to a whole
    chunk; a text without agreement even then is one piece.
    """
    starts, rest, widths = None, long, []
    while not widths or widths[-1] < chunk:
        widths.append(min(chunk, widths[-1] * 8 if widths else overlap))
        found = cut(chunk_starts(rest, chunk, widths[-1]), "bpe-starts")
        agreed = found.where("ok").select("rid", "starts")
        starts = agreed if starts is None else starts.union(agreed)
        open_ = found.where("not ok").select("rid")
        if open_.isEmpty():
            break
        rest = rest.join(open_, "rid", "left_semi")
    rows = long.join(starts, "rid", "left").select("rid", "text", F.coalesce("starts", F.array(F.lit(0).cast("long"))).alias("starts"))

    def pieces(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                bounds = [*map(int, r.starts), len(r.text)]
                for s in range(0, len(bounds) - 1, 64):
                    part = range(s, min(s + 64, len(bounds) - 1))
                    yield pd.DataFrame({"rid": r.rid, "i": list(part), "piece": [r.text[bounds[i] : bounds[i + 1]] for i in part]})

    # a text's pieces are dealt out, so that one long text is many tasks' work
    return rows.mapInPandas(pieces, "rid long, i long, piece string").repartition("rid", "i")


def chunk_starts(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(rid, ok, starts): where the pieces of each text begin, and whether all neighbours agree."""

    def parts(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                n = -(-len(r.text) // chunk)
                for s in range(0, n, 64):
                    part = range(s, min(s + 64, n))
                    yield pd.DataFrame({"rid": r.rid, "i": list(part), "size": len(r.text), "part": [r.text[i * chunk : (i + 1) * chunk + overlap] for i in part]})

    def edges(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                start = r.i * chunk
                b = safe_boundaries(r.part, start + len(r.part) >= r.size) + start
                out.append((r.rid, r.i, b[b <= start + overlap], b[b >= start + chunk]))
            yield pd.DataFrame(out, columns=["rid", "i", "head", "tail"])

    dealt = long.select("rid", "text").mapInPandas(parts, "rid long, i long, size long, part string").repartition("rid", "i")
    found = dealt.mapInPandas(edges, "rid long, i long, head array<long>, tail array<long>")
    before = F.lag("tail").over(W.partitionBy("rid").orderBy("i"))
    at = found.select("rid", "i", F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", before))).alias("at"))
    return at.groupBy("rid").agg(F.bool_and(F.col("at").isNotNull()).alias("ok"), F.sort_array(F.collect_list("at")).alias("starts"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
