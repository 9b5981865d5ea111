"""Encoding of whole corpora with a public byte-level BPE tokenizer, exactly, whatever the length of a text.

Overlapping chunk encoding: a text is cut into chunks of CHUNK_CHARS characters that overlap by
OVERLAP_CHARS; each chunk is pre-tokenised on its own, in parallel. The pre-tokenisation pattern reads
forward and looks ahead one character only, so two scans that share a boundary share all that follow:
neighbouring chunks are stitched at the first boundary behind no blank that both have in their overlap. Between two
stitches lies a piece whose pre-tokens are those of the whole text; the pieces are encoded in parallel
and their ids put one behind the other. If an overlap has no common boundary (a run of one class that
is longer than the overlap), the chunks on both sides are one piece.

Texts of at most one chunk take no shuffle. Longer ones are cut once; their chunks are written down with
their boundaries (positions in the overlaps), and only these are gathered per document, and the ids of
its pieces at the end, which the result holds in one row anyway. The texts are read twice: for the short
and for the long ones.

Null and empty texts give an empty list. Special tokens' strings in a text are ordinary text. Repeated
documents are encoded each; keys must be unique only among texts of more than one chunk. Extra columns
are dropped. The vocabulary file's path is a parameter; it must lie at that path on every executor, or
be found by the tokenizer package there.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from corpusmill.session import checkpointed

#: Path of the ranks of byte_bpe_50k.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, and of the overlap of two.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 14, 1 << 9


@functools.cache
def encoder(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(ids: list[int], path: str = VOCABULARY) -> bytes:
    """The bytes of a text: those of its tokens, one behind the other."""
    return encoder(path).decode_bytes(ids)


@functools.cache
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def chunk_starts(n_chars: int, chunk: int, overlap: int) -> list[int]:
    """Starts of the chunks of a text; the last one reaches its end."""
    if n_chars <= chunk:
        return [0]
    step = chunk - overlap
    return list(range(0, n_chars - overlap, step))


def bounds(text: str, final: bool, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries (pre-token starts) in a chunk's first and last `overlap` characters, from its start.

    The last pre-token of a chunk that is not the text's last may go on behind it, and the one before
    may owe its end to a look ahead: the last two boundaries of such a chunk are not trusted."""
    starts = [m.start() for m in _pattern().finditer(text)]
    if not final:
        starts = starts[:-2]
    # a run of blanks ends otherwise at the end of a piece than before a word: no piece may end behind a blank
    return [s for s in starts if s < overlap], [s for s in starts if s >= len(text) - overlap and not text[s - 1 : s].isspace()]


def meetings(heads: list[list[int]], tails: list[list[int]]) -> list[int | None]:
    """For every two neighbouring chunks the boundary (position in the text) at which they agree; heads and tails by chunk, in order."""
    out: list[int | None] = []
    last = -1
    for i in range(1, len(heads)):
        # a chunk's own first boundary is where it was cut, not one of the text, unless the one before has it
        common = set(tails[i - 1]) & set(heads[i])
        at = min(common) if common and min(common) > last else None
        out.append(at)
        last = last if at is None else at
    return out


def stitches(heads: list[list[int]], tails: list[list[int]]) -> list[int]:
    return [at for at in meetings(heads, tails) if at is not None]


def shares(starts: list[int], heads: list[list[int]], tails: list[list[int]], n_chars: int) -> list[dict]:
    """What each chunk gives to which piece: its start, and from where to where in the text. Chunks that do not agree are of one piece."""
    out, low, piece = [], 0, 0
    for start, after, at in zip(starts, [*starts[1:], n_chars], [*meetings(heads, tails), n_chars]):
        high = after if at is None else at
        out.append({"start": start, "low": low, "high": high, "piece": piece})
        low, piece = high, piece + (at is not None)
    return out


def _ids(texts: list[str], path: str) -> list[list[int]]:
    encode = encoder(path).encode_ordinary
    return [encode(t) if t else [] for t in texts]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """key, ids (array<int>) of every row."""
    kind = dict(documents.dtypes)[key]
    arrow_ids = pa.list_(pa.int32())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, arrow_ids)], names=["key", "ids"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t in zip(pdf["key"], pdf["text"]):
                starts = chunk_starts(len(t), chunk, overlap)
                yield pd.DataFrame({"key": k, "n": len(t), "start": starts, "part": [t[s : s + chunk] for s in starts]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [bounds(t, s + chunk >= n, overlap) for t, s, n in zip(pdf["part"], pdf["start"], pdf["n"])]
            pdf["head"] = [[s + x for x in h] for s, (h, _) in zip(pdf["start"], both)]
            pdf["tail"] = [[s + x for x in t] for s, (_, t) in zip(pdf["start"], both)]
            yield pdf

    @F.pandas_udf("array<struct<start:int,low:int,high:int,piece:int>>")
    def stitch(n: pd.Series, chunks: pd.Series) -> pd.Series:
        out = []
        for n_chars, rows in zip(n, chunks):
            rows = sorted(rows, key=lambda r: r["start"])
            out.append(shares([r["start"] for r in rows], [list(r["head"]) for r in rows], [list(r["tail"]) for r in rows], n_chars))
        return pd.Series(out)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "piece": pdf["piece"], "ids": _ids(list(pdf["part"]), path)})

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(n <= chunk).mapInArrow(whole, f"key {kind}, ids array<int>")
    # the chunks of long texts are dealt over the cluster; they carry their text from here on, so no text is read or copied again
    chunks = rows.where(n > chunk).mapInPandas(cut, f"key {kind}, n int, start int, part string").repartition("key", "start")
    chunks = checkpointed(chunks.mapInPandas(scan, f"key {kind}, n int, start int, part string, head array<int>, tail array<int>"))
    marks = chunks.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("start", "head", "tail")).alias("chunks"))
    given = marks.select("key", F.inline(stitch("n", "chunks")))
    parts = chunks.join(given, ["key", "start"]).select("key", "piece", "start", F.substring("part", F.col("low") - F.col("start") + 1, F.col("high") - F.col("low")).alias("part"))
    texts = parts.groupBy("key", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("part"))
    coded = texts.mapInPandas(pieces, f"key {kind}, piece int, ids array<int>")
    joined = coded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(joined).withColumnRenamed("key", key)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """`keep` columns and n_tokens of every row. No shuffle: a count needs no ids to be put together."""
    schema = documents.select(*keep).schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            encode = encoder(path).encode_ordinary
            counts = [len(encode(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return documents.select(*keep, text).mapInArrow(run, f"{schema}, n_tokens long")
