"""Cross-tokenizer alignment by products of hand-built CSR incidence matrices.

Each text is encoded by two tokenizers.  The token-byte incidence matrices A and B
(a row per token, a one per byte that it covers) are built in CSR form; the rows of
A times B transposed, by Gustavson's row product, are the overlap links: token pairs
with the number of bytes they share.  The byte offsets where tokens of both sides
end cut the text into groups; the token-group incidence matrices, multiplied the
same way, give the shared-group links.

1. One pass over the texts writes, per document, its digest columns and its
   distinct linked id pairs with their multiplicity.
2. Spark counts in how many documents each id pair is linked.
3. The counts go back to the documents in slices of bounded size; each slice is
   broadcast, and what a document finds in the slices is summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import shared, staged

#: Id pairs of one broadcast slice of the count table: 17 bytes each, 51 MB at most.
SLICE_PAIRS = 3_000_000
#: Texts of one product have at most about so many bytes (a longer text is alone), and
#: at most so many entries of a product are held at once.
CHUNK_BYTES, CHUNK_LINKS = 2_000_000, 4_000_000
#: Texts of these characters only are split alike by every regular expression library.
COMMON = regex.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
SPACE = "▁"


# -- tokenizers -------------------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


class ByteLevel:
    """A byte-level BPE given as a tokenizers file; ``token_bytes[id]`` are its bytes.

    The merges run in tiktoken, whose ranks are the ids of the merged tokens; a text
    with a character beyond COMMON goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        alphabet = byte_alphabet()
        made = [bytes(alphabet[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        ids = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        single = sorted((t for t in ids if len(t) == 1))
        order = single + list(dict.fromkeys(made))
        self.size = self.exact.get_vocab_size()
        self.token_bytes = [b""] * self.size
        for t, i in ids.items():
            self.token_bytes[i] = t
        self.to_id = np.array([ids[t] for t in order], np.int64)
        self.fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, special_tokens={},
                                      mergeable_ranks={t: i for i, t in enumerate(order)})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            t = " " + t
            out.append(self.to_id[self.fast.encode_to_numpy(t, disallowed_special=())] if COMMON(t) else
                       np.array(self.exact.encode(t, add_special_tokens=False).ids, np.int64))
        return out


class Pieces:
    """A sentencepiece model, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.token_bytes = []
        for i in range(self.size):
            p = self.model.id_to_piece(i)
            self.token_bytes.append(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


# -- sparse matrices --------------------------------------------------------------------------

class Csr:
    """Rows of column numbers: row i holds ``indices[indptr[i]:indptr[i + 1]]``, all ones."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray):
        self.indptr, self.indices = indptr, indices

    def rows(self, lo: int, hi: int) -> Csr:
        return Csr(self.indptr[lo:hi + 1] - self.indptr[lo], self.indices[self.indptr[lo]:self.indptr[hi]])


def starts(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def gustavson(a: Csr, bt: Csr, most: int = CHUNK_LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product of ``a`` and ``bt`` in coordinates (row, column, value), a run of
    rows at a time with about ``most`` terms (one row may have more).

    Row i of the product is the sum of the rows of ``bt`` that row i of ``a`` names.
    Terms of equal column follow each other when both matrices are sorted; otherwise
    the run is sorted first.
    """
    term_ends = np.cumsum((bt.indptr[1:] - bt.indptr[:-1])[a.indices]) if len(a.indices) else np.zeros(0, np.int64)
    row_ends = np.concatenate([[0], term_ends])[a.indptr[1:]]
    lo = 0
    while lo < len(row_ends):
        before = row_ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(row_ends, before + most, "right")))
        part = a.rows(lo, hi)
        begin = bt.indptr[part.indices]
        sizes = bt.indptr[part.indices + 1] - begin
        row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(part.indptr)), sizes)
        at = np.arange(len(row)) - np.repeat(starts(sizes)[:-1] - begin, sizes)
        col = bt.indices[at]
        if len(row):
            if np.any((row[1:] == row[:-1]) & (col[1:] < col[:-1])):
                order = np.lexsort((col, row))
                row, col = row[order], col[order]
            first = np.concatenate([[0], np.flatnonzero((row[1:] != row[:-1]) | (col[1:] != col[:-1])) + 1])
            yield row[first], col[first], np.diff(np.append(first, len(row)))
        lo = hi


def token_byte(sizes: np.ndarray) -> Csr:
    """Tokens x bytes: consecutive tokens of these sizes."""
    ends = starts(sizes)
    return Csr(ends, np.arange(ends[-1]))


def byte_token(sizes: np.ndarray) -> Csr:
    """The transpose of ``token_byte``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return Csr(np.arange(len(owner) + 1), owner)


def groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of both sides; both cover the same bytes."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)


def group_products(a_group: np.ndarray, b_group: np.ndarray):
    """Shared-group links (A token, B token): token-group incidence times its like."""
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    return gustavson(Csr(np.arange(len(a_group) + 1), a_group),
                     Csr(starts(np.bincount(b_group, minlength=n)), np.arange(len(b_group))))


# -- one chunk of texts -----------------------------------------------------------------------

class Aligner:
    """Alignment of chunks of texts by two tokenizers."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.a_len = np.array([len(t) for t in a.token_bytes], np.int64)
        self.b_len = np.array([len(t) for t in b.token_bytes], np.int64)
        number = [str(i) for i in range(max(a.size, b.size))]
        # an id with what follows it: the next of its side, the other side, the next group, the end
        self.text = [n + s for s in (",", "|", ";", "") for n in number]
        self.ids = len(number)

    def whole(self, tokenizer, found: np.ndarray, data: bytes) -> bool:
        return b"".join(map(tokenizer.token_bytes.__getitem__, found.tolist())) == data

    def chunk(self, texts: list[str | None]) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, n_overlaps, groups string, and its
        distinct linked pairs as codes a * size of B + b, with multiplicity."""
        none = (0, 0, 0, 0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        out, kept, ia, ib = [none] * len(texts), [], [], []
        given = [k for k, t in enumerate(texts) if t]
        shown = [texts[k] for k in given]
        for k, t, x, y in zip(given, shown, self.a.encode(shown), self.b.encode(shown)):
            data = (" " + t).encode("utf-8", "surrogatepass")
            if self.whole(self.a, x, data) and self.whole(self.b, y, data):
                kept.append(k)
                ia.append(x)
                ib.append(y)
        if not kept:
            return out
        a_at, b_at = starts(np.array([len(x) for x in ia])), starts(np.array([len(x) for x in ib]))
        a_ids, b_ids = np.concatenate(ia), np.concatenate(ib)
        a_sizes, b_sizes = self.a_len[a_ids], self.b_len[b_ids]
        a_doc, docs = np.repeat(np.arange(len(kept)), np.diff(a_at)), len(kept)

        overlaps = np.zeros(docs, np.int64)
        for row, _, _ in gustavson(token_byte(a_sizes), byte_token(b_sizes)):
            overlaps += np.bincount(a_doc[row], minlength=docs)

        a_group, b_group = groups(a_sizes, b_sizes)
        last = a_group[a_at[1:] - 1] + 1
        n_groups = np.diff(last, prepend=0)
        links, found = np.zeros(docs, np.int64), []
        width = self.a.size * self.b.size
        for row, col, _ in group_products(a_group, b_group):
            links += np.bincount(a_doc[row], minlength=docs)
            found.append(np.unique(a_doc[row] * width + a_ids[row] * self.b.size + b_ids[col], return_counts=True))
        codes, times = found[0]
        if len(found) > 1:
            codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            times = np.zeros(len(codes), np.int64)
            np.add.at(times, at, np.concatenate([t for _, t in found]))
        cut = np.searchsorted(codes, np.arange(docs + 1) * width)

        # every id at its place in the string: A ids of a group, its B ids, the next group
        n = int(last[-1])
        a_of, b_of = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        word = np.empty(len(a_ids) + len(b_ids), np.int64)
        a_place = np.arange(len(a_ids)) + (np.cumsum(b_of) - b_of)[a_group]
        b_place = np.arange(len(b_ids)) + np.cumsum(a_of)[b_group]
        a_last = np.append(a_group[1:] != a_group[:-1], True)
        b_last = np.append(b_group[1:] != b_group[:-1], True)
        word[a_place] = a_ids + self.ids * a_last
        word[b_place] = b_ids + 2 * self.ids * b_last
        ends = a_at + b_at
        word[ends[1:] - 1] += self.ids  # the last id of a document: nothing follows
        for d, k in enumerate(kept):
            s = "".join(map(self.text.__getitem__, word[ends[d]:ends[d + 1]].tolist()))
            out[k] = (int(a_at[d + 1] - a_at[d]), int(b_at[d + 1] - b_at[d]), int(n_groups[d]), int(links[d]),
                      int(overlaps[d]), s, codes[cut[d]:cut[d + 1]] - d * width, times[cut[d]:cut[d + 1]])
        return out


def chunks(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, "
           "groups_sha256 string, groups string, codes binary, times binary")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: counts of tokens, groups and links, the sha256 of
    the groups, with ``with_groups`` the groups themselves (``a1,a2|b1;a3|b2,b3``), and
    the distinct linked id pairs (``codes``: a * size of B + b, ``times``; both little-
    endian 64-bit numbers).

    Null and empty texts, and texts that one tokenizer does not give back byte by
    byte, have no tokens: zeros, '' and no pairs.  Ids play no part: repeated or null
    ones give a row each.  No rows: no rows.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(ByteLevel(a_path), Pieces(b_path))
        for b in batches:
            ids, lo = b["doc_id"], 0
            for part in chunks([t if isinstance(t, str) else None for t in b["text"]]):
                rows = []
                for na, nb, ng, nl, no, s, codes, times in aligner.chunk(part):
                    rows.append((na, nb, ng, nl, no, "" if s is None else hashlib.sha256(s.encode()).hexdigest(),
                                 s if with_groups else None, codes.tobytes(), times.tobytes()))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")[1:]])
                out.insert(0, "doc_id", ids.iloc[lo:lo + len(part)].to_numpy())
                lo += len(part)
                yield out

    # ids as text: pandas has no exact long beside nulls
    given = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInPandas(run, ALIGNED.replace("doc_id long", "doc_id string")).withColumn(
        "doc_id", F.col("doc_id").cast("long"))


# -- corpus-wide counts -----------------------------------------------------------------------

def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(code, n, best): in how many rows each id pair is linked, and whether that is the
    highest count of its A id.  Counted per batch first, then by Spark."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                found = b"".join(b["codes"].iloc[lo:lo + 2000])
                code, n = np.unique(np.frombuffer(found, np.int64), return_counts=True)
                yield pd.DataFrame({"code": code, "n": n})

    n = staged(aligned.select("codes").mapInPandas(run, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")), "pairs")
    a_id = F.expr(f"code div {b_size}")
    top = n.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    return n.withColumn("a", a_id).join(top, "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def _found(aligned: DataFrame, counts: DataFrame, columns: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``aligned`` with n_best and count_sum over the pairs in ``counts``."""
    table = counts.toArrow()
    code = table["code"].to_numpy()
    order = np.argsort(code)
    given = shared(aligned.sparkSession, (code[order], table["n"].to_numpy()[order],
                                          table["best"].to_numpy(zero_copy_only=False)[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, n, best = given()
        for b in batches:
            n_best, total = [], []
            for c, t in zip(b["codes"], b["times"]):
                c, t = np.frombuffer(c, np.int64), np.frombuffer(t, np.int64)
                at = np.searchsorted(code, c)
                hit = np.flatnonzero(code[np.minimum(at, len(code) - 1)] == c) if len(code) else at[:0]
                at, t = at[hit], t[hit]
                n_best.append(int(t[best[at]].sum()))
                total.append(int((t * n[at]).sum()))
            yield b[keep].assign(n_best=n_best, count_sum=total)
    return aligned.select(*keep, "codes", "times").mapInPandas(run, columns + ", n_best long, count_sum long")


def with_counts(aligned: DataFrame, b_size: int, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """``aligned`` (a written table) with ``n_best`` and ``count_sum``, without codes.

    The count table goes to the documents in slices of about ``slice_pairs`` pairs,
    dealt by a hash of the pair; with several, each document's sums are added up.
    """
    kept = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "groups"]
    counts = staged(pair_counts(aligned, b_size), "pair_counts")
    n = max(1, -(-counts.count() // slice_pairs))
    row = "row string, doc_id string"  # as text: pandas has no exact long beside nulls
    texts = aligned.withColumns({"row": F.col("row").cast("string"), "doc_id": F.col("doc_id").cast("string")})
    if n == 1:
        types = ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in kept)
        return _found(texts, counts, f"{row}, {types}", ["row", "doc_id", *kept]).withColumn(
            "doc_id", F.col("doc_id").cast("long")).drop("row")
    parts = None
    for k in range(n):
        part = staged(_found(texts, counts.filter(F.pmod(F.xxhash64("code"), F.lit(n)) == k), "row string", ["row"]),
                      "slice")
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy(F.col("row").cast("long").alias("row")).agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select("row", "doc_id", *kept).join(sums, "row").drop("row")


def cross_token_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                       with_groups: bool = False, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """The alignment of ``align`` with, per row, ``n_best`` (links whose id pair is
    linked in as many rows as any pair of its A id) and ``count_sum`` (the sum of the
    rows that link its pair, over all links)."""
    aligned = align(docs, a_path, b_path, id_col, text_col, with_groups)
    # the row number is fixed once it is written
    table = staged(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    return with_counts(table, Pieces(b_path).size, slice_pairs)


def op11_cross_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers as P
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cross_token_counts(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).drop("groups")
