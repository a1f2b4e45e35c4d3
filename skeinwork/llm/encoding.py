"""Encoding of a corpus with a public byte-level BPE tokenizer.

Ordinary texts are encoded in Arrow batches.  A text with a long *unsplit* piece (a run that the
tokenizer's own splitter leaves whole, such as thousands of letters without a blank) is encoded by
tree concatenation:

1. The text is cut into segments at piece boundaries; a piece longer than ``half_limit`` is halved
   until its parts are short enough.  The parts become rows and are encoded in parallel.
2. The parts of a piece are joined as a tree.  At each join a window of tokens on both sides is
   encoded again, and grown until its first token equals the left side's and its last token the right
   side's.  A token sequence is the encoding of its text exactly if every adjacent pair of tokens is
   the encoding of the pair's text; with both ends agreeing, every pair lies within one encoding.

So the result equals that of encoding the whole text at once, for texts of any length.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k.json"
#: Largest vocabulary file that is sent to the executors.
MAX_FILE = 64 << 20
HALF_LIMIT = 2048
LONG_TEXT = 16384
_cache: dict[int, object] = {}


def tokenizer_source(path: str | None = None) -> str:
    """The tokenizer's JSON as text; a public file of bounded size, sent along with the tasks."""
    path = path or os.path.join(TOKENIZERS, DEFAULT)
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    with open(path, encoding="utf-8") as file:
        return file.read()


def load(source: str):
    """The tokenizer, once per Python worker; strings of special tokens count as ordinary text."""
    key = hash(source)
    if key not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _cache[key] = tokenizer
    return _cache[key]


def is_plain_byte_bpe(source: str) -> bool:
    """Whether pieces can be joined token by token: byte-level BPE without normalizer, prefix or dropout."""
    spec = json.loads(source)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    return (
        model["type"] == "BPE"
        and not spec.get("normalizer")
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )


def encode_piece(tokenizer, piece: str) -> list[tuple[int, str]]:
    """Tokens (id, value) of one piece in the tokenizer's byte alphabet, without splitting it."""
    return [(t.id, t.value) for t in tokenizer.model.tokenize(piece)] if piece else []


def join(tokenizer, left: list[tuple[int, str]], right: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Encoding of the concatenation of two encoded parts of one piece."""
    if not left or not right:
        return left + right
    reach = 4
    while True:
        a, b = left[-reach:], right[:reach]
        window = encode_piece(tokenizer, "".join(v for _, v in a) + "".join(v for _, v in b))
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        reach *= 2


def join_tree(tokenizer, parts: list[list[tuple[int, str]]]) -> list[tuple[int, str]]:
    while len(parts) > 1:
        parts = [join(tokenizer, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def halves(piece: str, limit: int) -> list[str]:
    """The piece, halved until no part is longer than ``limit`` characters."""
    if len(piece) <= limit:
        return [piece]
    middle = len(piece) // 2
    return halves(piece[:middle], limit) + halves(piece[middle:], limit)


def segments(tokenizer, text: str, half_limit: int, segment_chars: int) -> Iterator[tuple[int, int, str]]:
    """(group, kind, part) in text order: kind 0 is ordinary text, kind 1 a part of one piece.

    The splitter works from left to right, so a cut where a piece ends is safe but for its look-ahead:
    it leaves the last blank of a run to what follows.  A segment that would end in both parts of such
    a run gives up the last one, which becomes a piece of its own.
    """
    group, start = 0, 0
    last: list[tuple[str, int, int]] = []  # the last two pieces of the open segment

    def close(end: int) -> Iterator[tuple[int, int, str]]:
        nonlocal group
        if end <= start:
            return
        tail = None
        if len(last) == 2 and all(text[a:b].isspace() for _, a, b in last):
            tail, _, _ = last[1]
            end = last[1][1]
        yield group, 0, text[start:end]
        group += 1
        if tail is not None:
            yield group, 1, tail
            group += 1

    end = 0
    for piece, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text):
        if len(piece) > half_limit:
            yield from close(a)
            for part in halves(piece, half_limit):
                yield group, 1, part
            group, start, last = group + 1, b, []
        else:
            if a - start >= segment_chars:
                yield from close(a)
                start, last = a, []
            last = [*last[-1:], (piece, a, b)]
        end = b
    yield from close(end)


def encode_text(tokenizer, text: str, half_limit: int = HALF_LIMIT) -> list[int]:
    """One text by tree concatenation, in one process (for tests and single texts)."""
    out: list[int] = []
    parts: list[list[tuple[int, str]]] = []
    last = None
    for group, kind, part in segments(tokenizer, text, half_limit, LONG_TEXT):
        if group != last:
            out += [i for i, _ in join_tree(tokenizer, parts)]
            parts, last = [], group
        if kind:
            parts.append(encode_piece(tokenizer, part))
        else:
            out += tokenizer.encode(part, add_special_tokens=False).ids
    return out + [i for i, _ in join_tree(tokenizer, parts)]


def encode(
    df: DataFrame, key: str, text: str, tokenizer_path: str | None = None, long_text: int = LONG_TEXT, half_limit: int = HALF_LIMIT
) -> DataFrame:
    """``key`` and ``ids`` (array<int>, no special tokens) for every row of ``df``.

    Null and empty texts give an empty array.  Every row gives a row, repeated ones too; a null key is
    kept.  Texts up to ``long_text`` characters are encoded where they are; longer ones are cut into
    rows, spread over the cluster, and put together again per text.  Only the two columns are read.
    """
    source = tokenizer_source(tokenizer_path)
    schema = f"key {df.schema[key].dataType.simpleString()}, ids array<int>"
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(source)
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text").to_pylist()
            encoded = tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            ids = pa.array([e.ids for e in encoded], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, ids], ["key", "ids"])

    if not is_plain_byte_bpe(source):
        return rows.mapInArrow(plain, schema).withColumnRenamed("key", key)
    is_long = F.coalesce(F.char_length("text") > long_text, F.lit(False))
    short = rows.where(~is_long).mapInArrow(plain, schema)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(source)
        for frame in frames:
            for row, key_, text_ in zip(frame["row"], frame["key"], frame["text"]):
                found = list(segments(tokenizer, text_, half_limit, long_text))
                yield pd.DataFrame(
                    {"row": row, "key": pd.Series([key_] * len(found), dtype=frame["key"].dtype), "seq": range(len(found)), "grp": [g for g, _, _ in found], "kind": [k for _, k, _ in found], "part": [p for _, _, p in found]}
                )

    def encode_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(source)
        for frame in frames:
            ids = [
                [i for i, _ in encode_piece(tokenizer, part)] if kind else tokenizer.encode(part, add_special_tokens=False).ids
                for kind, part in zip(frame["kind"], frame["part"])
            ]
            yield frame.drop(columns="part").assign(ids=ids)

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        tokenizer = load(source)
        out: list[int] = []
        ordered = group.sort_values("seq")
        for (_, kind), run in ordered.groupby(["grp", "kind"], sort=True):
            if kind:
                parts = [[(int(i), tokenizer.id_to_token(int(i))) for i in ids] for ids in run["ids"]]
                out += [i for i, _ in join_tree(tokenizer, parts)]
            else:
                for ids in run["ids"]:
                    out += [int(i) for i in ids]
        return pd.DataFrame({"key": group["key"].iloc[:1].tolist(), "ids": [out]})

    key_type = df.schema[key].dataType.simpleString()
    part_schema = f"row string, key {key_type}, seq int, grp int, kind int"
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a retried task must give its rows the same identity: it is drawn from content, numbered among equals
    tagged = rows.where(is_long).withColumn("row", F.sha2(F.concat_ws("\x01", F.col("key").cast("string"), "text"), 256))
    equal = tagged.groupBy("row").agg(F.first("key").alias("key"), F.first("text").alias("text"), F.count("*").alias("copies"))
    parts = equal.select("row", "key", "text").mapInPandas(cut, part_schema + ", part string")
    coded = parts.repartition(width, "row", "seq").mapInPandas(encode_parts, part_schema + ", ids array<int>")
    whole = coded.groupBy("row").applyInPandas(lambda k, g: put_together(g).assign(row=k[0]), schema + ", row string")
    copies = equal.select("row", "copies")
    long = whole.join(copies, "row").select("key", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_n")).drop("_n")
    return short.unionByName(long).withColumnRenamed("key", key)
