"""Chat formatting as prefix trees: turns that conversations share at their start are emitted once.

A turn reads `<|im_start|>role\\n text <|im_end|>\\n` without the blanks. Backslashes are doubled and `<|` becomes
`<\\|` inside roles and texts, so no text can hold a marker, and both are undone when read.

Conversations are known by the chained digest of their turns; equal ones are kept once. Distinct ones are
put in order by their chains of digests, which is depth-first order of the trees, and written in blocks.
Within a block every shared turn stands once, before all turns that follow on it. Each turn's tokens have
positions that go on from its parent's, and the intervals of its ancestors, which together with the turn
itself are all it may attend to. A block is a training sequence of its own, so a tree that is cut at the
end of a block repeats the turns above the cut in the next.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .bpe import byte_table
from .tokens import default_path, encoder

START, END, ROLE_END, TURN_END = "<|im_start|>", "<|im_end|>", "\n", "\n"
BLOCK_TOKENS = 1 << 16
LEARNED = "assistant"
_UNDO = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END) + r"\n\Z", re.S)

NODE = "struct<start: bigint, end: bigint, parent: bigint, position: bigint, loss_start: bigint, loss_end: bigint, attends: array<struct<start: bigint, end: bigint>>>"
BLOCK = f"ids binary, positions binary, nodes array<{NODE}>, leaves array<struct<conversation: binary, node: bigint>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _UNDO.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    m = _TURN.match(formatted)
    return unescape_role(m[1]), unescape(m[2])


def conversation_rows(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, leaf (digest of all turns) and path (digest up to each turn), with roles and texts in turn order.

    A conversation is one row, as a document is. Null roles and texts are empty; equal turn numbers go by
    role and text, null turn numbers first.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")) \
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")) \
        .select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            paths = []
            for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                path, last = [], b""
                for role, text in zip(roles, texts):
                    r, t = role.encode(), text.encode()
                    last = hashlib.blake2b(last + len(r).to_bytes(8, "big") + r + t, digest_size=16).digest()
                    path.append(last)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p[-1] for p in paths], pa.binary()), pa.array(paths, pa.list_(pa.binary())), b.column(1), b.column(2)],
                                             names=["conv_id", "leaf", "path", "roles", "texts"])

    return rows.mapInArrow(run, f"conv_id {kind}, leaf binary, path array<binary>, roles array<string>, texts array<string>")


class _Block:
    """Nodes of the trees of one block, in the order they are emitted."""

    def __init__(self, enc):
        self.enc, self.ids, self.size = enc, [], 0
        self.nodes, self.leaves, self.stack = [], [], []  # stack: digest and node of the current path

    def add(self, path, roles, texts) -> None:
        shared = 0
        while shared < min(len(self.stack), len(path)) and self.stack[shared][0] == path[shared]:
            shared += 1
        del self.stack[shared:]
        for digest, role, text in zip(path[shared:], roles[shared:], texts[shared:]):
            parent = self.stack[-1][1] if self.stack else -1
            parts = [self.enc.ids(x) for x in (START + escape_role(role) + ROLE_END, escape(text), END + TURN_END)]
            begin = self.size
            inner = begin + len(parts[0])
            self.size += sum(map(len, parts))
            above = self.nodes[parent] if self.stack else None
            attends = []
            if above:
                attends = [*above["attends"]]
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1] = {"start": attends[-1]["start"], "end": above["end"]}
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            learned = role == LEARNED
            self.nodes.append({"start": begin, "end": self.size, "parent": parent, "position": above["position"] + above["end"] - above["start"] if above else 0,
                               "loss_start": inner if learned else begin, "loss_end": inner + len(parts[1]) if learned else begin, "attends": attends})
            self.ids += parts
            self.stack.append((digest, len(self.nodes) - 1))
        self.leaves.append({"conversation": path[-1], "node": self.stack[-1][1]})

    def row(self, schema) -> pa.RecordBatch:
        positions = np.concatenate([np.arange(n["position"], n["position"] + n["end"] - n["start"], dtype="<u4") for n in self.nodes])
        ids = np.concatenate(self.ids).tobytes()
        return pa.RecordBatch.from_pylist([{"ids": ids, "positions": positions.tobytes(), "nodes": self.nodes, "leaves": self.leaves}], schema=schema)


def _arrow_schema() -> pa.Schema:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    node = pa.struct([*[(n, pa.int64()) for n in ("start", "end", "parent", "position", "loss_start", "loss_end")], ("attends", pa.list_(span))])
    return pa.schema([("ids", pa.binary()), ("positions", pa.binary()), ("nodes", pa.list_(node)), ("leaves", pa.list_(pa.struct([("conversation", pa.binary()), ("node", pa.int64())])))])


def tree_blocks(conversations: DataFrame, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of prefix trees from conversation_rows(): ids, positions (four bytes each), nodes and leaves.

    loss_start and loss_end bound the tokens of an assistant's text; for other roles the interval is empty.
    """
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    first = conversations.groupBy("leaf").agg(F.min("conv_id").alias("conv_id"))
    rows = first.alias("f").join(conversations.alias("c"), F.expr("f.conv_id <=> c.conv_id")).select("path", "roles", "texts")  # a null id is an id
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        enc, schema, block = encoder(tokenizer), _arrow_schema(), None
        for b in batches:
            for path, roles, texts in zip(*[c.to_pylist() for c in b.columns]):
                block = block or _Block(enc)
                block.add(path, roles, texts)
                if block.size >= block_tokens:
                    yield block.row(schema)
                    block = None
        if block:
            yield block.row(schema)

    return rows.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(run, BLOCK)


def read_back(blocks: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """leaf, turns (role, text), learned (all text under the loss mask) and formatted, for every distinct conversation."""
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    dtype = encoder(tokenizer).dtype
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("leaf", pa.binary()), ("turns", pa.list_(turn)), ("learned", pa.string()), ("formatted", pa.string())])

    def run(batches):
        piece = byte_table(tokenizer).__getitem__
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=dtype)
                text = lambda a, z: b"".join(map(piece, ids[a:z].tolist())).decode()  # noqa: E731, B023
                nodes = row["nodes"]
                whole = [text(n["start"], n["end"]) for n in nodes]
                learned = [unescape(text(n["loss_start"], n["loss_end"])) for n in nodes]
                turns = [dict(zip(("role", "text"), parse_turn(w))) for w in whole]
                out = []
                for leaf in row["leaves"]:
                    chain, at = [], leaf["node"]
                    while at >= 0:
                        chain.append(at)
                        at = nodes[at]["parent"]
                    chain.reverse()
                    out.append({"leaf": leaf["conversation"], "turns": [turns[i] for i in chain], "learned": "".join(learned[i] for i in chain), "formatted": "".join(whole[i] for i in chain)})
                    if len(out) == 64:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return blocks.select("ids", "nodes", "leaves").mapInArrow(run, "leaf binary, turns array<struct<role: string, text: string>>, learned string, formatted string")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The members (conv_id, leaf) and the written blocks of all conversations.

    Empty tables give none of either. Repeated rows are turns like others. Other columns take no part.
    """
    rows = settle(conversation_rows(turns, conv_col))
    return rows.select("conv_id", "leaf"), settle(tree_blocks(rows, tokenizer))
