"""Alignment of the tokens of two tokenizers on the same bytes, and how often their ids meet in the corpus.

1. Each task encodes a text with both tokenizers; the running sums of token bytes are two arrays of ends.
2. Diagonal run skipping: at the present shift between the two indices, stretches of growing width are
   compared as a whole until one differs, then the first different end is read off. So a stretch in which both
   tokenizers cut alike costs a logarithm of compares. At the next difference both arrays are walked token
   by token to the first end they share; that is one group, and the shift is updated.
3. Two tokens are linked where their bytes overlap. A block of a few MB of documents sends each pair of ids
   once with its count. Spark adds the counts up, finds the highest count of each id of the second
   tokenizer and gives every block the figures of its pairs, from which its documents take theirs.

A pair that occurs everywhere is one row per block, added up partly before the shuffle. A block has at most
BLOCK_BYTES of text, or one longer text, and never more pairs than links.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_table
from .token_files import new_folder
from .tokens import PieceEncoder, byte_characters, default_path

BLOCK_BYTES = 4 << 20
NEAR = 8  # ends compared one by one before stretches are; the first stretch has as many
STRETCH = 600  # characters, about, that sentencepiece gets at once
_CUT = re.compile("(?<=[^ ]) ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray):
    """Runs of one-to-one groups (first tokens of a, first tokens of b, lengths), and the links of all other groups as (tokens of a, tokens of b).

    Both arrays rise strictly and have the same last value.
    """
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.astype("<u8").tobytes(), ends_b.astype("<u8").tobytes()
    first_a, first_b, lengths, link_a, link_b = [], [], [], [], []
    linked_a, linked_b = link_a.append, link_b.append
    i, j, size = 0, 0, len(list_a)
    list_a.append(-1)  # no end: stops every compare
    while i < size:
        begin_a, begin_b, near = i, j, i + NEAR
        while i < near and list_a[i] == list_b[j]:  # the first widths are single ends
            i += 1
            j += 1
            if i == size:
                break
        if i == near and i < size:
            at_a, at_b, width = 8 * i, 8 * j, 8 * NEAR
            while (probe := raw_a[at_a:at_a + width]) and probe == (other := raw_b[at_b:at_b + width]):
                at_a += len(probe)
                at_b += len(probe)
                width *= 2
            if probe:  # the lowest bit that differs lies in the first end that does; past an array's end stands zero
                differ = int.from_bytes(probe, "little") ^ int.from_bytes(other, "little")
                at_a += (differ & -differ).bit_length() - 1 >> 6 << 3
            i, j = at_a >> 3, begin_b + (at_a >> 3) - begin_a
        if i > begin_a:
            first_a.append(begin_a)
            first_b.append(begin_b)
            lengths.append(i - begin_a)
            if i == size:
                break
        x, y = list_a[i], list_b[j]
        while x != y:
            linked_a(i)
            linked_b(j)
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        linked_a(i)
        linked_b(j)
        i += 1
        j += 1
    return np.array([first_a, first_b, lengths], dtype=np.int64), np.array(link_a, dtype=np.int64), np.array(link_b, dtype=np.int64)


@dataclass(slots=True)
class Alignment:
    """Ids of both tokenizers, whether a token is the last of its group, and the token indices of every link."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @classmethod
    def of(cls, ids_a, ids_b, ends_a, ends_b) -> Alignment:
        (first_a, first_b, length), walked_a, walked_b = common_ends(ends_a, ends_b)
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        run_a, run_b = np.repeat(first_a, length) + step, np.repeat(first_b, length) + step
        last_a, last_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
        last_a[run_a] = last_b[run_b] = True
        closing = ends_a[walked_a] == ends_b[walked_b]
        last_a[walked_a[closing]] = last_b[walked_b[closing]] = True
        return cls(ids_a, ids_b, last_a, last_b, np.concatenate((run_a, walked_a)), np.concatenate((run_b, walked_b)))

    def groups(self) -> list[tuple[list[int], list[int]]]:
        """The ids of each group."""
        a, b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1
        return [(x.tolist(), y.tolist()) for x, y in zip(np.split(self.ids_a, a)[:-1], np.split(self.ids_b, b)[:-1])]

    def packed(self) -> bytes:
        """The ids in four bytes each, then the group ends as bits."""
        return b"".join((self.ids_a.astype("<u4").tobytes(), self.ids_b.astype("<u4").tobytes(), np.packbits(self.last_a).tobytes(), np.packbits(self.last_b).tobytes()))


def groups_of(packed: bytes, n_a: int, n_b: int) -> list[tuple[list[int], list[int]]]:
    """The groups of Alignment.packed()."""
    ids = np.frombuffer(packed, dtype="<u4", count=n_a + n_b)
    bits = np.frombuffer(packed, dtype=np.uint8, offset=4 * (n_a + n_b))
    cut = (n_a + 7) // 8
    last_a, last_b = np.unpackbits(bits[:cut], count=n_a).astype(bool), np.unpackbits(bits[cut:], count=n_b).astype(bool)
    none = np.zeros(0, dtype=np.int64)
    return Alignment(ids[:n_a], ids[n_a:], last_a, last_b, none, none).groups()


class Tokenizers:
    """Both tokenizers of a process, with the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str, most: int):
        from sentencepiece import SentencePieceProcessor
        self.a = PieceEncoder(path_a, most)
        self.a.tokenizer.encode_special_tokens, self.a.added = True, []  # their strings inside texts are plain text
        self.bytes_a = byte_table(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts_at_spaces = not any(re.search("[^▁]▁", p) for p in pieces)  # no merge ever crosses into a run of spaces
        #: A byte-level file without a normalizer that has every byte cannot change a text.
        self.a_keeps_bytes = self.a.space_leads and set(byte_characters()) <= set(self.a.tokenizer.get_vocab())
        self.size_a, self.size_b = (np.fromiter(map(len, t), dtype=np.int64, count=len(t)) for t in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = (np.array([f"{i}{sep}" for sep in seps for i in range(len(t))], dtype="S8").view(np.uint64) for seps, t in ((",|", self.bytes_a), (",;", self.bytes_b)))

    def encode_b(self, text: str) -> np.ndarray:
        """The ids of the whole text, encoded in short stretches, as merging takes more than linear time.

        They end before a space that follows something else, where no piece can lie; sentencepiece puts that space back.
        """
        if not self.cuts_at_spaces or "▁" in text:
            return np.array(self.b.encode(text), dtype=np.int64)
        ids, begin, size = [], 0, len(text)
        while begin < size:
            found = _CUT.search(text, begin + STRETCH)
            end = found.start() if found and found.end() < size else size
            ids += self.b.encode(text[begin:end])
            begin = end + 1
        return np.array(ids, dtype=np.int64)

    def align(self, text: str | None) -> Alignment | None:
        """The alignment, or None for a text that is null, empty or changed by one of the tokenizers."""
        if not text:
            return None
        want = f" {text}".encode()
        ids_a, ids_b = self.a.ids(f" {text}").astype(np.int64), self.encode_b(text)
        if not (self.a_keeps_bytes or b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == want) or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != want:
            return None
        return Alignment.of(ids_a, ids_b, np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))

    def written(self, found: Alignment) -> bytes:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        ends_a, starts_b = np.flatnonzero(found.last_a) + 1, np.append(0, np.flatnonzero(found.last_b) + 1)
        n_a, n_b = len(found.ids_a), len(found.ids_b)
        out = np.empty(n_a + n_b, dtype=np.uint64)  # eight characters each: vocabularies have fewer than ten million ids
        out[np.arange(n_a) + starts_b[np.cumsum(found.last_a) - found.last_a]] = self.text_a[found.ids_a + len(self.bytes_a) * found.last_a]
        out[np.arange(n_b) + ends_a[np.cumsum(found.last_b) - found.last_b]] = self.text_b[found.ids_b + len(self.bytes_b) * found.last_b]
        return out.tobytes().translate(None, b"\0")[:-1]


_loaded: dict[tuple, Tokenizers] = {}


def tokenizers(path_a: str, path_b: str, most: int) -> Tokenizers:
    if (path_a, path_b, most) not in _loaded:
        _loaded[path_a, path_b, most] = Tokenizers(path_a, path_b, most)
    return _loaded[path_a, path_b, most]


def keep_groups(tools: Tokenizers, found: Alignment) -> bytes:
    """What align() keeps of a text by default; groups_of() reads it."""
    return found.packed()


def keep_digest(tools: Tokenizers, found: Alignment) -> bytes:
    """Only the hex digest of the written groups, where a caller needs no more."""
    return hashlib.sha256(tools.written(found)).hexdigest().encode()


_DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, kept binary, n_pairs int, pairs binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())


class _Block:
    """Documents of one block: their figures, and their pairs of ids with how often each is linked."""

    def __init__(self):
        self.ids, self.figures, self.pairs, self.size = [], [], [], 0

    def rows(self, name: str, id_type: pa.DataType) -> pa.RecordBatch:
        """One row per document, pairs as places in the sorted list of the block, which is in the first row."""
        every = np.unique(np.concatenate([k for k, _ in self.pairs] + [np.zeros(0, dtype=np.int64)]))
        total = np.zeros(len(every), dtype=np.int64)
        packed = []
        for keys, n in self.pairs:
            at = np.searchsorted(every, keys)
            total[at] += n
            packed.append(pa.compress(np.concatenate((np.diff(at, prepend=0), n)).astype("<u4").tobytes(), codec="zstd", asbytes=True))
        columns = [[*f, len(k), p] for f, (k, _), p in zip(self.figures, self.pairs, packed)]
        first = lambda x: [x.astype("<i8").tobytes()] + [None] * (len(columns) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(columns)), pa.array(self.ids, id_type), *[pa.array([c[k] for c in columns], t) for k, t in enumerate(_KINDS)], pa.array(first(every), pa.binary()), pa.array(first(total), pa.binary())],
            names=["block", "id", *[c.split()[0] for c in _DOCUMENT.split(", ")], "keys", "counts"])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, keep=keep_groups, most: int = 800_000) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and kept (what `keep` makes of the alignment) of every row.

    Tokenizer a is a byte-level file, b a sentencepiece model that puts a space first; both read space+text.
    n_links counts pairs of tokens that overlap, n_best those whose pair of ids is, in the whole corpus, the
    most frequent one of its id of b (ties all count), count_sum adds the corpus counts of all links.

    Null and empty texts, and texts whose bytes a tokenizer changes, have zeros and a null kept. Repeated rows
    count each; null ids stay. A very long text is a block of its own. An empty table gives no rows. Other
    columns take no part. Blocks are written once, so a lost executor cannot cut them otherwise; each worker
    remembers at most `most` pre-tokens.
    """
    spark = docs.sparkSession
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()
    wide = len(tokenizers(path_a, path_b, most).bytes_b)

    def encode(batches):
        tools, part, done = tokenizers(path_a, path_b, most), TaskContext.get().partitionId(), 0
        block, id_type = _Block(), None
        none = np.zeros(0, dtype=np.int64)
        for b in batches:
            id_type = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                size = len(text) if text else 0
                if block.size and block.size + size > BLOCK_BYTES:
                    yield block.rows(f"{part}-{done}", id_type)
                    block, done = _Block(), done + 1
                found = tools.align(text)
                block.ids.append(i)
                block.size += size
                if found is None:
                    block.figures.append((0, 0, 0, 0, None))
                    block.pairs.append((none, none))
                else:
                    block.figures.append((len(found.ids_a), len(found.ids_b), int(found.last_a.sum()), len(found.link_a), keep(tools, found)))
                    block.pairs.append(np.unique(found.ids_a[found.link_a] * wide + found.ids_b[found.link_b], return_counts=True))
        if block.ids:
            yield block.rows(f"{part}-{done}", id_type)

    schema = f"block string, id {kind}, {_DOCUMENT}, keys binary, counts binary"
    folder = new_folder(spark)
    (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, schema).write.option("compression", "zstd").parquet(folder))
    written = spark.read.schema(schema).parquet(folder)

    def spread(batches):
        for b in batches:
            for block, keys, counts in zip(*[c.to_pylist() for c in b.columns]):
                keys, counts = np.frombuffer(keys, dtype="<i8"), np.frombuffer(counts, dtype="<i8")
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys)), pa.array(keys), pa.array(counts)], names=["block", "key", "n"])

    pairs = written.where("keys is not null").select("block", "keys", "counts").mapInArrow(spread, "block string, key bigint, n bigint")
    totals = pairs.groupBy("key").agg(F.sum("n").alias("n")).withColumn("b", F.col("key") % wide)
    highest = totals.groupBy("b").agg(F.max("n").alias("most"))
    figures = totals.join(highest, "b").select("key", F.col("n").alias("total"), (F.col("n") == F.col("most")).alias("best"))
    answers = pairs.select("block", "key").join(figures, "key")

    def finish(documents: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("key").to_numpy())
        total, best = found.column("total").to_numpy()[order], found.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[order]
        n_best, count_sum = [], []
        for n, packed in zip(documents.column("n_pairs").to_pylist(), documents.column("pairs").to_pylist()):
            both = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype="<u4").astype(np.int64)
            at, times = np.cumsum(both[:n]), both[n:]
            n_best.append(int((times * best[at]).sum()))
            count_sum.append(int((times * total[at]).sum()))
        return pa.table({**{c: documents.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "kept": documents.column("kept")})

    return (written.drop("keys", "counts").groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(finish, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, kept binary"))
