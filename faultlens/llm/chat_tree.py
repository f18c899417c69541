"""Conversations as one prefix tree: turns that conversations begin with alike stand once.

A node is a turn with all turns before it, named by a chained 128-bit digest. It belongs to
the least conversation (by its id as text) that has it, so each conversation owns a run at
its end, its segment, and hangs on an earlier one. Segments are laid out depth first: a
segment, then what branches off it, the deepest branch first. Every node is one row of the
stream: its tokens, the place of its first token (``start``), its position within its own
conversation, the tokens under the loss mask, and the intervals of places that its tokens attend
to beside those before them in the row, which are exactly its ancestors. A conversation is the
list of intervals that read it back.

The template marks turns with control strings, each one token beyond the vocabulary; the same
strings in texts and roles are broken by a backslash, and backslashes doubled, so that both
read back. Defined results: null texts and roles are empty, a null turn comes first, turns of
one number (also rows that repeat) follow each other by role, then text; rows without an id
are one conversation of a null id; a text of any length is one node; an empty table gives
empty frames. A conversation is chained and read by one task, row by row, as its digests need
the turns in order: its memory is that of one turn.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text before the merges of the rank file: letters, digits, other marks and white space.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_TEXT, ROLE_END = CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[SEP]", "[/ROLE]"]
#: Characters given to the tokenizer at once.
PART = 1 << 16
#: Places of a block, as a power of two, by which intervals find the nodes that begin in them.
BLOCK_BITS = 10


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Coder:
    """Tokens of a rank file (UTF-8 bytes where there is none), and one for each control string behind them."""

    def __init__(self, path: str | None):
        self.encoding = None
        if path:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encoding = tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1 if path else 256
        self.control = {c: size + k for k, c in enumerate(CONTROLS)}
        self.text_of = {v: k for k, v in self.control.items()}

    def encode(self, text: str) -> list[int]:
        if self.encoding is None:
            return list(text.encode())
        return [t for at in range(0, len(text), PART) for t in self.encoding.encode_ordinary(text[at : at + PART])]

    def decode(self, tokens: list[int]) -> str:
        out, run = [], []

        def flush():
            out.append(bytes(run) if self.encoding is None else self.encoding.decode_bytes(run))
            run.clear()

        for t in tokens:
            if t in self.text_of:
                flush()
                out.append(self.text_of[t].encode())
            else:
                run.append(t)
        flush()
        return b"".join(out).decode()

    def turn(self, role: str, text: str, first: bool) -> tuple[list[int], int, int]:
        """Tokens of a turn, and which of them are under the loss mask."""
        c, body = self.control, self.encode(escaped(text))
        front = [c[BEGIN]] if first else []
        if role == "assistant":
            return [*front, *body, c[END]], len(front), len(front) + len(body)
        if role == "user":
            return [*front, c[USER], *body, c[USER_END]], 0, 0
        if role == "system":
            return [*front, c[SYSTEM], *body, c[SYSTEM_END]], 0, 0
        return [*front, c[ROLE], *self.encode(escaped(role)), c[ROLE_TEXT], *body, c[ROLE_END]], 0, 0


@lru_cache(maxsize=2)
def coder(path: str | None) -> Coder:
    return Coder(path)


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    turn = turn.removeprefix(BEGIN)
    for role, front, back in (("user", USER, USER_END), ("system", SYSTEM, SYSTEM_END), (None, ROLE, ROLE_END), ("assistant", "", END)):
        if turn.startswith(front) and turn.endswith(back):
            body = turn[len(front) : len(turn) - len(back)]
            if role is None:
                named, body = body.split(ROLE_TEXT)
                role = unescaped(named)
            return role, unescaped(body)
    raise ValueError("a turn without its marks")


def _chained(path: str | None):
    """Rows in order of conversation and turn -> a node each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, key, node, i, position = coder(path), None, b"", 0, 0
        for batch in batches:
            out = []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if k != key:
                    key, node, i, position = k, b"", 0, 0
                name = role.encode()
                node = hashlib.blake2b(node + len(name).to_bytes(8, "big") + name + text.encode(), digest_size=16).digest()
                tokens, a, b = code.turn(role, text, i == 0)
                out.append((i, node, position, tokens, a, b))
                i, position = i + 1, position + len(tokens)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
            made = [pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), *made], names=["key", "id", "i", "node", "position", "tokens", "loss_from", "loss_to"])

    return run


@dataclass
class Tree:
    """stream: start, tokens, position, loss_from, loss_to, attends, depth first by start; conversations: id, spans. Both stored."""

    stream: DataFrame
    conversations: DataFrame
    id_column: str


def build(conversations: DataFrame, tokenizer: str | None = TOKENIZER, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Tree:
    rows = conversations.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("key"), F.col(id_column).alias("id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "id", "role", "text")
    turns = Stored(ordered.mapInArrow(_chained(tokenizer), f"key string, id {kind}, i long, node binary, position long, tokens array<int>, loss_from int, loss_to int"), "turns")
    owners = Stored(turns.df.groupBy("node").agg(F.min("key").alias("owner")), "owners")
    # A conversation's path: the segments it runs through, each with its depth and position there.
    hops = turns.df.select("key", "node", "i", "position").join(owners.df, "node").groupBy("key", "owner").agg(F.min("i").alias("depth"), F.min("position").alias("at"))
    paths = hops.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("depth", "owner", "at"))).alias("hops"))
    whole = turns.df.groupBy("key").agg(F.any_value("id").alias("id"), F.max(F.col("position") + F.size("tokens")).alias("total"))
    paths = Stored(paths.join(whole, "key"), "paths")
    starts = Stored(_starts(paths.df), "starts")
    last = F.element_at("hops", -1)
    each = paths.df.select("key", "total", "hops", F.posexplode("hops").alias("j", "hop"))
    each = each.select("key", "j", F.col("hop.owner").alias("owner"), (F.coalesce(F.get("hops", F.col("j") + 1)["at"], F.col("total")) - F.col("hop.at")).alias("length"))
    spans = each.join(starts.df, "owner").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("j", F.col("start"), (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = Stored(paths.df.join(spans, "key").select("key", "id", last["owner"].alias("owner"), last["at"].alias("at"), plain.alias("spans")), "spans")
    segments = found.df.where("owner = key").select("key", "at", F.element_at("spans", -1)["start"].alias("first"), F.slice("spans", 1, F.size("spans") - 1).alias("before"))
    own = turns.df.join(owners.df.withColumnRenamed("owner", "key"), ["node", "key"]).join(segments, "key")
    start = F.col("first") + F.col("position") - F.col("at")
    upto = F.when(start > F.col("first"), F.array(F.struct(F.col("first").alias("start"), start.alias("end")))).otherwise(F.slice("before", 1, 0))
    stream = Stored(own.select(start.alias("start"), "tokens", "position", "loss_from", "loss_to", F.concat("before", upto).alias("attends")), "stream")
    for old in (turns, owners, paths, starts):
        old.drop()
    return Tree(stream.df, found.df.select(F.col("id").alias(id_column), "spans"), id_column)


def _starts(paths: DataFrame) -> DataFrame:
    """owner, start: the place of each segment's first token, depth first."""
    last = F.element_at("hops", -1)
    # Deeper branches come first, a segment before what hangs on it.
    order = F.transform("hops", lambda h: F.struct((-h["depth"]).alias("up"), h["owner"].alias("owner")))
    own = paths.where(last["owner"] == F.col("key")).select(F.col("key").alias("owner"), order.alias("order"), (F.col("total") - last["at"]).alias("length"))
    dealt = Stored(own.repartitionByRange("order").withColumn("part", F.spark_partition_id()), "segments")
    sizes = dealt.df.groupBy("part").agg(F.sum("length").alias("n")).orderBy("part").collect()  # a row for each partition
    base, at = [], 0
    for r in sizes:
        base.append((r["part"], at))
        at += r["n"]
    bases = paths.sparkSession.createDataFrame(base, "part int, base long")
    before = Window.partitionBy("part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.df.withColumn("before", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return within.join(F.broadcast(bases), "part").select("owner", (F.col("base") + F.col("before")).alias("start"))


def _digests(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, out, leaf = coder(path), [], None
        turns = loss = None
        n = loss_chars = chars = place = 0

        def row():
            return (leaf, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        def made():
            kinds = {"leaf": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
            return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(kinds.items())})

        for batch in batches:
            for own, position, tokens, a, b in zip(*(batch.column(c).to_pylist() for c in ("leaf", "position", "tokens", "loss_from", "loss_to")), strict=True):
                if own != leaf:
                    if turns:
                        out.append(row())
                    leaf, turns, loss, n, loss_chars, chars, place = own, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                if position != place:
                    raise ValueError(f"positions of the conversation that ends at {leaf} have a gap at {place}")
                text = code.decode(tokens)
                role, said = parsed(text)
                turns.update(f"{role}\n{said}\n".encode())
                masked = unescaped(code.decode(tokens[a:b]))
                loss.update(masked.encode())
                n, loss_chars, chars, place = n + 1, loss_chars + len(masked), chars + len(text), place + len(tokens)
            yield made()
            out.clear()
        if turns:
            out.append(row())
        yield made()

    return run


def read_back(tree: Tree, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, by the intervals of each conversation; equal ones are read once."""
    leaf: Column = F.element_at("spans", -1)["end"]
    named = tree.conversations.withColumn("leaf", leaf)
    span = named.groupBy("leaf").agg(F.any_value("spans").alias("spans")).select("leaf", F.explode("spans").alias("s"))
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    asked = span.select("leaf", "s.start", "s.end", F.explode(F.sequence(block(F.col("s.start")), block(F.col("s.end") - 1))).alias("block"))
    nodes = tree.stream.select(F.col("start").alias("place"), block(F.col("start")).alias("block"), "position", "tokens", "loss_from", "loss_to")
    met = asked.join(nodes, "block").where("place >= start AND place < end").select("leaf", "position", "tokens", "loss_from", "loss_to")
    ordered = met.repartition("leaf").sortWithinPartitions("leaf", "position")
    read = ordered.mapInArrow(_digests(tokenizer), "leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return named.join(read, "leaf").select(tree.id_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def template_case(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Conversation -1, whose texts are made of control strings, as rows of ``like``'s conv_id, turn, role and text."""
    kinds = ", ".join(f"{c} {like.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role", "text"))
    return spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], kinds)
