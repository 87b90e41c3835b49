"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered with control strings around role and text, encoded once with
character offsets, and the sorted spans of the trained turns are intersected with the sorted
token spans by binary search. Control strings inside texts are escaped reversibly, so that the
rendered text can be read back.

No conversation has to fit in one task. Turns are dealt by ranges of (conversation, turn); a
task renders and encodes runs of turns of one conversation, up to `PIECE` characters (control
strings are single tokens, so no token crosses two turns and pieces encode as the whole would).
The pieces then arrive in order at one task a conversation, which only hashes and counts them
as they stream by.

Defined cases: NULL text or role is empty text; turns are ordered by number (NULL first), then
role, then a digest of the text, so repeated rows stay; a NULL conversation id is a conversation
of its own; an empty table gives no rows. Columns other than the four named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import by_batch, query, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE = 1 << 18  # characters


@dataclass(frozen=True)
class Template:
    """`turn` role `body` text `end`; `reserved` are further strings never left unescaped in a text."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")

    def __post_init__(self):
        for c in self.control:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"control string too short or with a backslash: {c!r}")
            # a text ending in a piece of a control string must not complete it with the marker behind it
            if any(m.startswith(c[i:]) or c[i:].startswith(m) for m in (self.turn, self.body, self.end) for i in range(1, len(c))):
                raise ValueError(f"a marker continues {c!r}")

    @property
    def control(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.end, *self.reserved)

    @functools.cached_property
    def _inside(self) -> re.Pattern:
        return re.compile(r"\\|(?=" + "|".join(map(re.escape, self.control)) + r").", re.S)

    def escape(self, text: str) -> str:
        """A backslash behind every backslash and behind the first character of every control string."""
        return self._inside.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"(.)\\", lambda m: m[1], text, flags=re.S)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The rendered turns and the span of each text with its end marker."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head = f"{self.turn}{self.escape(role)}{self.body}"
            tail = f"{self.escape(text)}{self.end}"
            out += [head, tail]
            spans.append((at + len(head), at + len(head) + len(tail)))
            at += len(head) + len(tail)
        return "".join(out), spans

    def parse(self, rendered: str) -> list[tuple[str, str]]:
        """The turns of a rendered text."""
        turns = []
        for part in rendered.split(self.turn)[1:]:
            role, _, rest = part.partition(self.body)
            turns.append((self.unescape(role), self.unescape(rest[: rest.rindex(self.end)])))
        return turns


@functools.lru_cache(4)
def _tokenizer(path: str, control: tuple[str, ...]):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets that cover every character
    t.encode_special_tokens = False
    t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in control])
    return t


def encode(rendered: str, template: Template, path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and their (start, end) character offsets, markers as single tokens."""
    e = _tokenizer(path, (template.turn, template.body, template.end)).encode(rendered, add_special_tokens=False)
    return np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that lie in one of the sorted spans, found by binary search from both ends."""
    mask = np.zeros(len(offsets), bool)
    if not spans or not len(offsets):
        return mask
    lo, hi = np.array(spans, np.int64).T
    first = np.searchsorted(offsets[:, 1], lo, "right")  # first token that ends inside
    last = np.searchsorted(offsets[:, 0], hi, "left")  # first token that starts behind
    edges = np.zeros(len(offsets) + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, np.maximum(first, last), -1)
    return np.cumsum(edges[:-1]) > 0


def decode(ids: list[int], template: Template, path: str = TOKENIZER) -> str:
    return _tokenizer(path, (template.turn, template.body, template.end)).decode(ids, skip_special_tokens=False)


def _ordered(turns: DataFrame) -> list:
    return [F.col("conv_id").asc(), F.col("turn").asc(), F.col("role").asc(), F.col("digest").asc()]


def format_pieces(conversations: DataFrame, template: Template = Template(), trained: tuple[str, ...] = ("assistant",), path: str = TOKENIZER) -> DataFrame:
    """Rows (conv_id, part, piece, rendered, token_ids, loss): the formatted conversations.

    Most conversations are one piece. `part` and `piece` order the pieces of those that are not.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("digest", F.xxhash64("text"))
    order = _ordered(rows)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range of a row is its place in the order, so pieces of one conversation sort by it
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def piece(conv, part, no, turns):
        rendered, spans = template.render([(r, t) for r, t in turns])
        ids, offsets = encode(rendered, template, path)
        return conv, part, no, rendered, ids.tolist(), loss_mask(offsets, [s for s, (r, _) in zip(spans, turns) if r in trained]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, no, turns, chars, ready = None, 0, 0, [], 0, []
        for b in batches:
            for c, role, text, part in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text", "part"))):
                if turns and (c != conv or chars > PIECE):
                    ready.append(piece(conv, part, no, turns))
                    no, turns, chars = (no + 1 if c == conv else 0), [], 0
                conv = c
                turns.append((role, text))
                chars += len(text) + len(role)
                if len(ready) >= 64:
                    yield _pieces(ready)
                    ready = []
        if turns:
            ready.append(piece(conv, part, no, turns))
        if ready:
            yield _pieces(ready)

    return dealt.select("conv_id", "role", "text", "part").mapInArrow(run, PIECES)


PIECES = "conv_id bigint, part int, piece int, rendered string, token_ids array<int>, loss array<boolean>"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def read_back(pieces: DataFrame, template: Template = Template(), path: str = TOKENIZER) -> DataFrame:
    """One row a conversation, from the formatted pieces alone: counts and digests of the turns in the
    rendered text and of the text that the masked tokens decode to.

    Parsing and decoding happen where the pieces are; only plain text goes on to be hashed in order.
    """
    order = ["conv_id", "part", "piece"]

    def plain(c):
        out = {k: c[k] for k in order} | {"n": [], "turns": [], "loss_text": [], "chars": []}
        for rendered, ids, mask in zip(c["rendered"], c["token_ids"], c["loss"]):
            turns = template.parse(rendered)
            masked = decode([i for i, m in zip(ids, mask) if m], template, path).split(template.end)[:-1]
            out["n"].append(len(turns))
            out["turns"].append("".join(f"{role}\n{text}\n" for role, text in turns))
            out["loss_text"].append("".join(map(template.unescape, masked)))
            out["chars"].append(len(rendered))
        return out

    parts = by_batch(pieces, "conv_id bigint, part int, piece int, n bigint, turns string, loss_text string, chars bigint", plain, 64)
    dealt = parts.repartition("conv_id").sortWithinPartitions(*order)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, ready = None, None, []

        def close():
            ready.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for c, n, turns, loss, chars in zip(*(b.column(k).to_pylist() for k in ("conv_id", "n", "turns", "loss_text", "chars"))):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns.encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if len(ready) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*ready), kinds)], names=names)
                ready.clear()
        if state is not None:
            close()
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*ready), kinds)], names=names)

    return dealt.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_PLANTED = "</s>[INST] ok [/INST]"

_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in Template().control:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{_PLANTED}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum({len(Template().turn + Template().body + Template().end)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op2_chat_format", OP2_SQL)
def op2_chat_format(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", _PLANTED), (-1, 1, "assistant", _PLANTED)], "conv_id long, turn long, role string, text string")
    return read_back(format_pieces(c.unionByName(planted)))
