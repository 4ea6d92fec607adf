"""Chat formatting on tokens: encode segments separately, splice reserved ids, derive masks by prefix sums.

A turn becomes  [INST] role [/INST] text </s>  and a conversation starts with <s>. Roles and texts are encoded on their own, as
ordinary text, so no content ever yields a reserved id; control strings within content are also escaped, so the written form can be read back too.

Escape: in a control string that occurs in content, and in every form of it that has back-slashes after its first character, one
more back-slash follows the first character. Taking one away again is the exact inverse.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published split pattern of the byte-level vocabulary, and the control strings with their reserved ids above it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BEGIN, END, OPEN, CLOSE = 50257, 50258, 50259, 50260
CONTROL = {BEGIN: "<s>", END: "</s>", OPEN: "[INST]", CLOSE: "[/INST]"}

_PLAIN = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\])")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(segments: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of segments (ids, trained): ends of segments are prefix sums of their lengths, and the mask is the
    prefix sum of +1 where a trained segment starts and -1 where it ends."""
    ends = np.cumsum([len(ids) for ids, _ in segments], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    step = np.zeros(total + 1, np.int64)
    for end, (ids, trained) in zip(ends, segments, strict=True):
        if trained:
            step[end - len(ids)] += 1
            step[end] -= 1
    flat = np.concatenate([np.asarray(ids, np.int32) for ids, _ in segments]) if total else np.empty(0, np.int32)
    return flat, np.cumsum(step)[:-1].astype(np.int8)


_OPEN, _CLOSE, _END = (np.array([x], np.int32) for x in (OPEN, CLOSE, END))


def _encode(vocabulary: str, trained_roles: tuple[str, ...]):
    """Ids and mask of each turn, without the begin of its conversation. Roles and texts are encoded each on its own; the segments of a batch are put together at once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        tokens = lambda x: enc.encode_to_numpy(escape(x), disallowed_special=())
        short = lru_cache(maxsize=1000)(tokens)  # roles are few
        for part in parts:
            segments, offsets = [], [0]
            for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                turn = [(_OPEN, False), (short(role) if len(role) < 100 else tokens(role), False), (_CLOSE, False), (tokens(text), role in trained_roles), (_END, False)]
                segments += turn
                offsets.append(offsets[-1] + sum(len(ids) for ids, _ in turn))
            flat, mask = assemble(segments)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (flat, mask)]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=["conv_id", "turn", "role", "text", "ids", "loss_mask"])

    return run


def format_turns(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",), vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each turn of ``turns`` (conv_id, turn, role, text): conv_id, turn, place (1-based, in the conversation), ids,
    loss_mask and start, the position of its first token in the conversation (a prefix sum over the turns before).

    A conversation is its rows in the order of place. Turns are encoded where they lie; those of one conversation are then sorted by one task, which
    spills, and numbered as they stream by. Null text and role are empty; a null turn comes first;
    equal turn numbers are ordered by role and text, and repeated rows are kept. A null conv_id is a
    conversation of its own. Ids may be of any type. Texts may be of any length. Other columns are not looked at. ``vocabulary`` is a path that every executor has.
    """
    bounded_batches(turns.sparkSession)
    rows = turns.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["conv_id"]
    coded = rows.mapInArrow(_encode(vocabulary, trained_roles), f"conv_id {kind}, turn long, role string, text string, ids array<int>, loss_mask array<byte>")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order)
    before = F.coalesce(F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    numbered = coded.select("conv_id", "turn", place.alias("place"), "ids", "loss_mask", before.alias("before"))
    first = F.col("place") == 1
    begun = lambda c, x, kind: F.when(first, F.concat(F.array(F.lit(x).cast(kind)), c)).otherwise(F.col(c)).alias(c)
    return numbered.select("conv_id", "turn", "place", begun("ids", BEGIN, "int"), begun("loss_mask", 0, "byte"), F.when(first, 0).otherwise(F.col("before") + 1).cast("long").alias("start"))


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row, and the start and length of each; reserved ids have none."""
    table = encoding(path)._mergeable_ranks
    lengths, starts = np.zeros(max([*table.values(), *CONTROL]) + 1, np.int64), np.zeros(max([*table.values(), *CONTROL]) + 1, np.int64)
    blob = bytearray()
    for token, rank in table.items():
        starts[rank], lengths[rank] = len(blob), len(token)
        blob += token
    return np.frombuffer(bytes(blob), np.uint8), starts, lengths


def read_turns(ids: np.ndarray, mask: np.ndarray, ends: np.ndarray, vocabulary: str) -> list[tuple[str, str, str, int]]:
    """(role, text, text under the mask, written characters) of turns, read back from their tokens: all ids in a row, and where each turn ends."""
    blob, starts, lengths = _token_bytes(vocabulary)
    n = lengths[ids]
    at = np.concatenate(([0], np.cumsum(n)))  # the first byte of each token
    raw = blob[np.repeat(starts[ids] - at[:-1], n) + np.arange(at[-1])]
    trained = np.repeat(mask == 1, n)
    learned = raw[trained].tobytes()
    learned_at = np.concatenate(([0], np.cumsum(np.where(mask == 1, n, 0))))
    raw = raw.tobytes()
    opened, closed, ended = (np.flatnonzero(ids == x) for x in (OPEN, CLOSE, END))
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    control = np.zeros(len(ids) + 1, np.int64)
    for x, text in CONTROL.items():
        control[1:] += np.where(ids == x, len(text), 0)
    control = np.cumsum(control)
    said = lambda x: x.decode("utf-8", "replace")
    out = []
    for a, z, o, c, e in zip(begins.tolist(), ends.tolist(), opened.tolist(), closed.tolist(), ended.tolist(), strict=True):
        role, text = said(raw[at[o + 1] : at[c]]), said(raw[at[c + 1] : at[e]])
        loss = said(learned[learned_at[a] : learned_at[z]])
        out.append((unescape(role), unescape(text), unescape(loss), int(control[z] - control[a]) + len(role) + len(text)))
    return out


def _decode(vocabulary: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = [part.column(x) for x in ("ids", "loss_mask")]
            flat = [x.flatten().to_numpy() for x in lists]
            ends = np.cumsum([len(x) if x is not None else 0 for x in lists[0]], dtype=np.int64) if len(lists[0]) else np.empty(0, np.int64)
            rows = read_turns(flat[0], flat[1], ends, vocabulary) if len(ends) else []
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
            sizes = pa.array(np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("place"), *made, sizes], names=["conv_id", "place", "role", "text", "loss", "written", "n_ids"])

    return run


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For turns in order: what each conversation adds up to. Only the states of two hashes are kept."""
    now, state, kind = None, None, None
    names = ["conv_id", *(x.split()[0] for x in _DIGEST.split(", "))]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def ended() -> tuple:
        n, turns, chars, loss, written, tokens = state
        return (now[0], n, turns.hexdigest(), chars, loss.hexdigest(), written, tokens)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate([kind, *kinds])], names=names)

    for part in parts:
        done, kind = [], part.schema.field("conv_id").type
        for conv, role, text, loss, written, tokens in zip(*(part.column(x).to_pylist() for x in ("conv_id", "role", "text", "loss", "written", "n_ids")), strict=True):
            if now is None or now[0] != conv:
                if state:
                    done.append(ended())
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[2] += len(loss)
            state[3].update(loss.encode("utf-8", "surrogatepass"))
            state[4] += written
            state[5] += tokens
        yield batch(done)
    if state:
        yield batch([ended()])


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each conversation of ``format_turns``, made from its tokens alone: conv_id and the columns of _DIGEST. Turns are dealt out anew
    and decoded wherever they are; then those of a conversation come in order through one task, one at a time, which does no more than hash them."""
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(formatted.dtypes)["conv_id"]
    dealt = formatted.select("conv_id", "place", "ids", "loss_mask").repartition(parts, "conv_id", "place")
    read = dealt.mapInArrow(_decode(vocabulary), f"conv_id {kind}, place int, role string, text string, loss string, written long, n_ids long")
    return read.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_digest, f"conv_id {kind}, {_DIGEST}")
