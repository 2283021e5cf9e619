"""Best-fit packing by sums of squares.

Documents are tokenized inside Arrow batches and cut into pieces of at most
``size`` tokens; only the piece table (a few numbers a piece) goes on.  Pieces
are dealt by hash into blocks of about ``BLOCK`` pieces and each block is packed
by itself: a piece goes where the sum over all gaps of (open bins with that gap)
squared becomes smallest.  The sequences that a block cannot close well go
through a second round, in blocks of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import staged

SIZE = 4096
END_ID = 1
#: Pieces of one block: what one task holds at once.
BLOCK = 40_000
#: Sequences filled less than this after the first round are packed again.
FULL = 0.98
#: Texts that the pattern below splits into words as the tokenizer does.
COMMON = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall


class WordTokenizer:
    """Ids of texts by a tokenizers file: lower case, words without white space, byte-level
    merges with an end-of-word mark.

    The merges run in tiktoken, with a blank after each word in place of the mark:
    ranks are single bytes, then bytes with the mark, then the merges in their order.
    A text with a character beyond COMMON, or with the string of an added token, goes to
    the tokenizers library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from kiln.llm.cross_tokens import byte_alphabet
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, self.added = file["model"], [t["content"] for t in file["added_tokens"]]
        self.exact = Tokenizer.from_file(path)
        alphabet, mark = byte_alphabet(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(mark)
            return bytes(alphabet[c] for c in (token[:-len(mark)] if end else token)) + b" " * end

        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t.removesuffix(mark))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = list(dict.fromkeys([bytes([b]) for b in range(256)] + [bytes([b, 32]) for b in range(256)]
                                   + [raw(x + y) for x, y in merges]))
        self.to_id = np.array([ids[t] for t in order], "<u4")
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", special_tokens={},
                                      mergeable_ranks={t: i for i, t in enumerate(order)})

    def encode(self, text: str) -> np.ndarray:
        if not COMMON(text) or any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        words = WORDS(text.lower())
        words.append("")
        return self.to_id[self.fast.encode_to_numpy(" ".join(words), disallowed_special=())]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs``.

    The ids of a text are those of the tokenizer, then ``end_id``; null text has
    the end id alone.  Texts of more than ``size`` ids are cut every ``size`` ids.
    Rows that share an id, or have none, each give their own pieces.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordTokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"], batch["text"]):
                ids = np.append(words.encode(t if isinstance(t, str) else ""), np.array([end_id], "<u4")).tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    rows.append((None if pd.isna(i) else int(i), k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")  # exact, also beside nulls
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    ``count[g]`` is the number of open bins with gap g.  Putting a piece of length
    s into a bin of gap g changes the sum of squares by
    2 * (count[g - s] - count[g]) + 2, or 1 - 2 * count[g] where it closes the bin;
    a new bin changes it by 2 * count[size - s] + 1.  Ties: the smallest gap,
    an open bin before a new one.
    """
    count = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        g = -1
        if s < size:
            open_gaps = np.flatnonzero(count[s:size]) + s
            if len(open_gaps):
                after = np.where(open_gaps == s, 0, 2 * count[open_gaps - s] + 1)
                change = after - 2 * count[open_gaps] + 1
                best = int(change.argmin())
                if change[best] <= 2 * count[size - s] + 1:
                    g = int(open_gaps[best])
        if g < 0:
            b, g = opened, size
            opened += 1
        else:
            b = stacks[g].pop()
            count[g] -= 1
        bins[k], offsets[k] = b, size - g
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def _pack_blocks(size: int, round_no: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        for block, group in rows.groupby("block", sort=True):
            g = group.sort_values(["length", "row"], ascending=[False, True], kind="stable")
            bins, offsets = sum_of_squares(g["length"].to_numpy(np.int64), size)
            fill = np.bincount(bins, weights=g["length"].to_numpy(np.float64))
            g = g.assign(sequence_id=(np.int64(round_no) << 62) | (np.int64(block) << 24) | bins,
                         offset=offsets, full=fill[bins] >= FULL * size)
            yield g.drop(columns=["block"])
    return pack


PACKED = ("row long, doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long, full boolean")


def _pack_round(rows: DataFrame, n: int, size: int, round_no: int) -> DataFrame:
    blocks = max(1, -(-n // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(blocks)))
    return dealt.repartition(blocks, "block").mapInPandas(_pack_blocks(size, round_no), PACKED)


def pack(piece_rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``piece_rows`` with ``sequence_id`` and ``offset`` (gapless from 0 in each
    sequence, at most ``size`` tokens).  Pieces are dealt by their row number, fixed
    once the table is written, so that repeated rows and null ids spread like all
    others; equal lengths go in row order.  No rows: no rows."""
    cut = staged(piece_rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    first = staged(_pack_round(cut, cut.count(), size, 0), "packed")
    rest = first.filter("not full").select(*cut.columns)
    again = _pack_round(rest, rest.count(), size, 1)
    return first.filter("full").unionByName(again).drop("full", "row")


def op5_best_fit_packing(spark, sf_dir):
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
