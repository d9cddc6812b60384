r"""Chat formatting of records in many layouts, chosen by a fingerprint of their nested field paths.

A record is a variant value: a whole conversation (prompt and completion, instruction and output, lists of messages) or
one turn of it.  Its fingerprint is the MD5 of those of its field paths that any layout knows; ``x[].y`` is a field of
some element of the list ``x``.  The fingerprint selects a layout, which says declaratively where roles and
texts are.  Other fields are ignored; a record of no layout stays as one row without layout, role and text.

A turn is written as ``<|im_start|>ROLE\nTEXT<|im_end|>\n``.  Inside roles and texts every ``<``, backslashes and ``|`` get
one backslash more, so that no control string is left, and a line feed in a role is written as ``<|n|>``; both
are undone when read back.  The loss mask is a range of characters in each turn: the text of trained roles.

Nulls: a null role or text is empty, a null record has no layout, and rows with a null id are one conversation.  Turn rows
come by number, null first, then by their written form; whole records come before them.  No records give no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut

START, END, FEED = "<|im_start|>", "<|im_end|>", "<|n|>"
CONTROL, WRITTEN = r"<(\\*)\|", r"<\\(\\*)\|"
TURNS = "array<struct<place:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a record's turns are.

    ``turns`` are pairs of a role and a path of a text; ``@path`` takes the role from the record.  With ``items`` they are in each
    element of that list; with ``place`` a record is one turn and has its number there.  ``optional`` paths may
    be absent; ``joined`` texts are added to the text before them behind a blank line.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    items: str = ""
    place: str = ""
    optional: tuple[str, ...] = ()
    joined: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        own = {text for _, text in self.turns} | {role[1:] for role, _ in self.turns if role[0] == "@"} | {x for _, x in self.joined}
        own |= {self.place} if self.place else set()
        return {f"{self.items}[]"} | {f"{self.items}[].{x}" for x in own} if self.items else own

    def path_sets(self) -> list[set[str]]:
        some = [set(gone) for n in range(len(self.optional) + 1) for gone in combinations(self.optional, n)]
        return [self.paths() - gone for gone in some] + ([{f"{self.items}[]"}] if self.items else [])


LAYOUTS = (
    Layout("turn row", (("@role", "text"),), place="turn"),
    Layout("messages", (("@role", "content"),), items="messages"),
    Layout("shares", (("@from", "value"),), items="conversations", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question", (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("assistant", "output")), optional=("system", "input"), joined=(("instruction", "input"),)),
)


def has_path(record: Column, path: str) -> Column:
    """Whether the record has a field, null or not; a path of a list's elements holds if any element has it."""
    inside, _, rest = path.partition("[]")
    if inside == path:
        return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()
    items = F.try_variant_get(record, f"$.{inside}", "array<variant>")
    return F.exists(items, lambda x: has_path(x, rest[1:])) if rest else items.isNotNull()


def fingerprint(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The record's field paths that any layout knows, sorted, a line each; their MD5 is the fingerprint."""
    known = sorted(set().union(*(x.paths() for x in layouts)))
    return F.concat_ws("\n", *(F.when(has_path(record, p), p) for p in known))


def _turns(record: Column, layout: Layout) -> Column:
    def turn(at: Column, role: str, text: str) -> Column:
        get = lambda path: F.coalesce(F.try_variant_get(at, f"$.{path}", "string"), F.lit(""))
        name = get(role[1:]) if role[0] == "@" else F.lit(role)
        for old, new in layout.roles:
            name = F.when(name == old, new).otherwise(name)
        whole = get(text)
        for _, extra in (j for j in layout.joined if j[0] == text):
            whole = F.when(get(extra) != "", F.concat(whole, F.lit("\n\n"), get(extra))).otherwise(whole)
        place = F.try_variant_get(at, f"$.{layout.place}", "bigint") if layout.place else F.lit(None).cast("bigint")
        found = F.struct(place.alias("place"), name.alias("role"), whole.alias("text"))
        return F.when(has_path(at, text), found) if text in layout.optional else found

    if layout.items:
        return F.transform(F.try_variant_get(record, f"$.{layout.items}", "array<variant>"), lambda x: turn(x, *layout.turns[0])).cast(TURNS)
    return F.array_compact(F.array(*(turn(record, *t) for t in layout.turns))).cast(TURNS)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, place, record_digest, record_no, pos, role, text): the turns of all records.

    The columns between layout and role order a conversation's turns: ``place`` is a turn row's number, the others are null there;
    a whole record has its digest, a number that keeps equal records apart, and the turn's position.
    """
    record = F.col("_record")
    names = {fingerprint(paths): x.name for x in layouts for paths in x.path_sets()}
    layout = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.md5(field_paths(record, layouts))]
    chosen = F.lit(None).cast(TURNS)
    for x in layouts:
        chosen = F.when(F.col("layout") == x.name, _turns(record, x)).otherwise(chosen)
    single = [x.name for x in layouts if x.place]
    whole = ~F.col("layout").isin(single)
    kept = records.select(F.col(id_col).alias("_id"), F.col(record_col).alias("_record"))
    found = kept.withColumn("layout", layout).select("_id", "layout", F.when(whole, F.xxhash64(F.to_json("_record"))).alias("record_digest"), F.when(whole, F.monotonically_increasing_id()).alias("record_no"), chosen.alias("_turns"))
    empty = F.col("layout").isNull()
    rows = found.select("*", F.posexplode_outer(F.when(empty, F.array(F.lit(None).cast("struct<place:bigint,role:string,text:string>"))).otherwise(F.col("_turns"))).alias("_pos", "_turn"))
    return rows.select(F.col("_id").alias(id_col), "layout", "_turn.place", "record_digest", "record_no", F.when(whole, F.col("_pos")).alias("pos"), "_turn.role", "_turn.text")


def layout_report(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(paths, fingerprint, n) of all records, to see which layouts are missing."""
    paths = field_paths(F.col(record_col), layouts)
    return records.groupBy(paths.alias("paths")).agg(F.count("*").alias("n")).select("paths", F.md5("paths").alias("fingerprint"), "n")


ORDER = ["place", "record_digest", "record_no", "pos", "piece"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, WRITTEN, "<$1|")


def format_turns(turns: DataFrame, id_col: str = "conv_id", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, order columns, piece, loss_start, loss_length): each turn as written, with the characters under the loss mask."""
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(FEED)), F.lit("\n"))
    rows = turns.filter(F.col("role").isNotNull()).select(id_col, *ORDER[:-1], head.alias("_head"), escaped(F.col("text")).alias("_text"), F.col("role").isin(*trained).alias("_trained"))
    piece = F.concat("_head", "_text", F.lit(f"{END}\n"))
    return rows.select(id_col, *ORDER[:-1], piece.alias("piece"), F.length("_head").alias("loss_start"), F.when(F.col("_trained"), F.length("_text")).otherwise(0).alias("loss_length"))


def read_back(pieces: DataFrame) -> DataFrame:
    """Adds ``role``, ``text`` and ``loss`` (the text under the mask), parsed from the written pieces."""
    parse = lambda group: F.regexp_extract("piece", r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$", group)
    role = unescaped(F.replace(parse(1), F.lit(FEED), F.lit("\n")))
    loss = unescaped(F.substring("piece", F.col("loss_start") + 1, F.col("loss_length")))
    return pieces.select("*", role.alias("role"), unescaped(parse(2)).alias("text"), loss.alias("loss"))


def conversation_digests(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of stored pieces, read back.

    A digest is a chain over a conversation's turns, so these stream through one task, a slice at a time.
    """
    rows = read_back(pieces).select(id_col, *ORDER, F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "loss", F.length("piece").cast("long").alias("n"))
    ordered = rows.repartition(id_col).sortWithinPartitions(id_col, *ORDER).select(id_col, "turn", "loss", "n")
    kind = pieces.schema[id_col].dataType.simpleString()

    def run(batches):
        schema, now, state, begun = None, None, None, False

        def close():
            n, turns, chars, loss, size = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            done = []
            for conv, turn, loss, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append(close())
                    now, state, begun = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                state[0], state[2], state[4] = state[0] + 1, state[2] + len(loss), state[4] + n
                state[1].update(turn.encode())
                state[3].update(loss.encode())
            if done:
                yield batch_of(schema, [list(c) for c in zip(*done, strict=True)])
        if begun:
            yield batch_of(schema, [[x] for x in close()])

    return ordered.mapInArrow(run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def store_chat(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Write formatted turns to the shared folder and reread them."""
    return cut(format_turns(turns, id_col), "chat")


def chat_sql(odd: str) -> str:
    """DuckDB SQL of the digests of ``conversations`` and conversation -1, whose two turns are ``odd``."""
    escape = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
    return f"""
WITH c AS (SELECT conv_id, turn, NULL AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, NULL, pos, role, '{odd}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(pos, role)),
p AS (SELECT *, '{START}' || replace({escape.format("role")}, chr(10), '{FEED}') || chr(10) || {escape.format("text")} || '{END}' || chr(10) AS piece FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, pos, piece)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, pos, piece) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(piece))::bigint AS formatted_chars
FROM p GROUP BY conv_id
"""
