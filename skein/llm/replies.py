"""Problem 7: conversations rebuilt from message rows, and those that are broken found.

Each conversation's rows form a reply graph, built from rows in any order: a row with a position answers the rows at the
position before it, a row that names its parent answers that one, an assistant's line of a Codex turn answers the turn's
user lines, and all others answer none. Kahn's algorithm sorts the graph topologically and breaks ties by timestamp and
id; nodes it can't reach lie in or behind a cycle. Roles and completeness are then checked along that order: a row whose
position's forerunner is missing is a second root.

A conversation may hold any share of all rows, so its graph is cut into blocks of its order, each of which only answers
itself and the block before it; a block is summed up as its first and last role, whether it breaks inside, its lowest and
highest position and counts, and these summaries join up by conversation.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.functions.jsons import readable
from skein.operators.nested import CHATGPT_LINKS, chatgpt_tables
from skein.operators.timestamps import message_instants
from skein.plans.blocks import last_known, running_sum, sortable, with_block
from skein.session import checkpoint

# Spellings of the roles, after trimming and lower-casing.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "ai": "assistant", "system": "system", "developer": "system", "tool": "tool"}
#: Texts put in by the client, not written by anyone.
SHIMS = ("<environment_context>", "<permissions instructions>")
BLOCK_ROWS = 4096
_SEEN = r"[^\s\p{Z}\p{C}͏ᅟᅠ឴឵᠋-᠏⠀ㅤﾠ︀-️]"


def visible(text: Column) -> Column:
    """Whether any character of the text is seen: not only spaces, format and control characters."""
    return F.coalesce(text.rlike(_SEEN), F.lit(False))


def plain_role(role: Column) -> Column:
    """user, assistant, system or tool; null for any other."""
    known = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.try_element_at(known, F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", "")))


def kahn(parents: list, keys: list) -> list[int]:
    """Topological order of a reply graph; parents holds the place of each node's parent, -1 for none, or a list of places;
    of the nodes that are ready the one of the least key comes first.

    Nodes in or behind a cycle are left out. Equal keys go by place.
    """
    children: list[list[int]] = [[] for _ in parents]
    waits = [0] * len(parents)
    for i, own in enumerate(parents):
        for p in own if isinstance(own, list) else (own,):
            if p >= 0:
                children[p].append(i)
                waits[i] += 1
    ready = [(keys[i], i) for i, n in enumerate(waits) if not n]
    heapq.heapify(ready)
    order = []
    while ready:
        _, i = heapq.heappop(ready)
        order.append(i)
        for c in children[i]:
            waits[c] -= 1
            if not waits[c]:
                heapq.heappush(ready, (keys[c], c))
    return order


def position_graph(positions: list[int | None]) -> tuple[list, bool]:
    """(parents of the rows, then of one joint for each position that several rows share; whether a row above the lowest
    position answers none).

    A row answers the row at the position before its own. Several rows of one position meet in a joint that follows them,
    so that the graph has no more edges than rows.
    """
    held: dict[int, list[int]] = {}
    for i, p in enumerate(positions):
        if p is not None:
            held.setdefault(p, []).append(i)
    joints, after = [], {}
    for p, own in held.items():
        after[p] = own[0] if len(own) == 1 else len(positions) + len(joints)
        if len(own) > 1:
            joints.append(own)
    parents = [-1 if p is None else after.get(p - 1, -1) for p in positions]
    lowest = min(held, default=0)
    return parents + joints, any(p != lowest and p - 1 not in held for p in held)


def reply_order_of(positions: list[int | None], keys: list) -> tuple[list[int], bool]:
    """(places of the rows in order, whether rows are left over or answer a missing one)."""
    parents, loose = position_graph(positions)
    n = len(positions)
    order = [i for i in kahn(parents, [*keys, *[("",)] * (len(parents) - n)]) if i < n]
    return order, loose or len(order) < n


def message_rows(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, id, position, role, seen, at, tie): one row for each message id, the latest delivery.

    ``at`` is the place in the order: the position, or where a row has none the instant of ts; ``tie`` is a string that
    sorts rows of one place by instant and id. Rows without a conversation are left out; a null id counts as one id of its
    conversation; a null ts comes first.
    """
    own = messages.where("conversation_id is not null").select("conversation_id", "id", "position", plain_role(F.col("role")).alias("role"), visible(F.col("content")).alias("seen"), "ts", "ingested_at")
    last = own.groupBy("conversation_id", "id").agg(F.max(F.struct("ingested_at", "position", "role", "seen", "ts")).alias("m"))
    last = checkpoint(last.select("conversation_id", "id", "m.position", "m.role", "m.seen", "m.ts"))
    # only rows without a position and those that share one need their instant
    shared = last.where("position is not null").groupBy("conversation_id", "position").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    free = last.where("position is null").unionByName(last.join(shared, ["conversation_id", "position"], "left_semi").select(*last.columns))
    timed = message_instants(free, conversations).where("utc_us is not null").groupBy("conversation_id", "id").agg(F.min("utc_us").alias("utc_us"))
    timed = timed.select(F.col("conversation_id").alias("c2"), F.col("id").alias("id2"), "utc_us")
    both = last.join(timed, F.expr("conversation_id = c2 and id <=> id2"), "left")
    tie = sortable(F.col("utc_us"), F.col("id"), sizes=(True,))
    return both.select("conversation_id", "id", "position", "role", "seen", F.coalesce(F.col("position").cast("bigint"), "utc_us").alias("at"), tie.alias("tie"))


def _clusters(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of consecutive equal values of the first ``n`` columns."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for key, own in groupby(rows, key=lambda r: r[:n]):
        yield key, list(own)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield _batch(out, schema)
            out = []
    yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def reply_blocks(rows: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (keys, position, at, tie and others) with their ``block``, the rows of a block beside each other in any order.

    Positions are cut at multiples, then all that is still too large at quantiles of ``at`` and of ``tie``.
    """
    start = F.when(F.col("position").isNotNull(), F.array(F.floor(F.col("position") / block_rows).cast("int"))).otherwise(F.array())
    placed = with_block(rows, keys, "at", block_rows, then="tie", start=start)
    named = placed.withColumn("block", F.concat_ws(".", F.transform("block", lambda b: F.lpad(b.cast("string"), 10, "0"))))
    return named.repartition(*keys, "block").sortWithinPartitions(*keys, "block")


def conversation_order(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conversation_id, block, step, id, role): the turns of each block in order; blocks follow each other by name."""
    schema = T.StructType.fromDDL("conversation_id STRING, block STRING, step INT, id STRING, role STRING")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def steps() -> Iterator[tuple]:
            for key, own in _clusters(batches, 2):
                order, _ = reply_order_of([r[4] for r in own], [(r[2] is not None, r[2] or 0, r[3]) for r in own])
                said = (own[i] for i in order if own[i][6] and own[i][7] is not None)
                yield from ((*key, step, r[5], r[7]) for step, r in enumerate(said))

        return _batches(steps(), arrow)

    return reply_blocks(rows, ["conversation_id"], block_rows).select("conversation_id", "block", "at", "tie", "position", "id", "seen", "role").mapInArrow(run, schema)


def block_summaries(rows: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS, turns: bool = False) -> DataFrame:
    """(keys, block, first, last, broken, users, answers, low, high): what each block says of its turns and positions.

    rows: (keys, position, at, tie, role, seen). first and last are the roles of its first and last user or assistant turn;
    broken: a user turn is followed by another one; loose: a row answers a missing one, or lies in or behind a cycle; users
    and answers: user and assistant turns; low and high: its lowest and highest position. With ``turns`` the assistant's
    rows answer the user's rows of the block, and positions don't count.
    """
    n = len(keys)
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL("block STRING, first STRING, last STRING, broken BOOLEAN, loose BOOLEAN, users BIGINT, answers BIGINT, low BIGINT, high BIGINT").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[tuple]:
            for key, own in _clusters(batches, n + 1):
                at, tie, position, talk = zip(*(r[n + 1 :] for r in own))
                order_keys = [(a is not None, a or 0, t) for a, t in zip(at, tie)]
                if turns:
                    asked = [i for i, r in enumerate(talk) if r == "user"]
                    joint = len(own)
                    order = [i for i in kahn([*(joint if r == "assistant" else -1 for r in talk), asked], [*order_keys, ("",)]) if i < joint]
                    loose, placed = len(order) < joint, []
                else:
                    order, loose = reply_order_of(position, order_keys)
                    placed = [p for p in position if p is not None]
                said = [talk[i] for i in order if talk[i] is not None]
                broken = any(a == b == "user" for a, b in zip(said, said[1:]))
                users = said.count("user")
                yield *key, said[0] if said else None, said[-1] if said else None, broken, loose, users, len(said) - users, min(placed, default=None), max(placed, default=None)

        return _batches(sums(), arrow)

    talk = F.when(F.col("seen") & F.col("role").isin("user", "assistant"), F.col("role"))
    return reply_blocks(rows, keys, block_rows).select(*keys, "block", "at", "tie", "position", talk.alias("talk")).mapInArrow(run, schema)


def broken_conversations(messages: DataFrame, conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conversation_id): ids of headers or messages with no header, no user turn, a user turn without an answer, or a
    position missing between 0 and the highest. Empty tables give none."""
    parts = checkpoint(block_summaries(checkpoint(message_rows(messages, conversations)), ["conversation_id"], block_rows))
    follow = Window.partitionBy("conversation_id").orderBy("block")
    spoken = parts.where("first is not null").select("conversation_id", ((F.col("last") == "user") & (F.coalesce(F.lead("first").over(follow), F.lit("user")) == "user")).alias("bad"))
    # a block's lowest position follows the highest of the block before it, or is that one again
    low, before = F.col("low"), F.coalesce(F.lag("high").over(follow), F.lit(-1))
    gaps = parts.where("low is not null").select("conversation_id", (~low.isin(before, before + 1) | (low < 0)).alias("bad"))
    torn = spoken.unionByName(gaps).where("bad").select("conversation_id").distinct().withColumn("torn", F.lit(True))
    whole = parts.groupBy("conversation_id").agg(F.bool_or(F.col("broken") | F.col("loose")).alias("broken"), F.sum("users").alias("users"))
    headers = conversations.where("id is not null").select(F.col("id").alias("conversation_id")).distinct().withColumn("header", F.lit(True))
    bad = F.col("header").isNull() | (F.coalesce("users", F.lit(0)) == 0) | F.coalesce("broken", F.lit(False)) | F.col("torn").isNotNull()
    return whole.join(torn, "conversation_id", "left").join(headers, "conversation_id", "full").where(bad).select("conversation_id")


def rebuilt_conversations(messages: DataFrame, conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conversation_id, block, step, id, role) of the turns of sound conversations, roles plain, in order of block and step."""
    rows = conversation_order(checkpoint(message_rows(messages, conversations)), block_rows)
    return rows.join(broken_conversations(messages, conversations, block_rows), "conversation_id", "left_anti")


def codex_messages(codex: DataFrame) -> DataFrame:
    """(session_file, line_no, turn_id, role, seen) of readable message lines; turn_id is the line's own or the last
    turn_context's before it, null if there is neither."""
    parsed = readable(codex, "line").select("session_file", "line_no", "parsed")
    get = lambda p, t="string": F.try_variant_get("parsed", p, t)
    content = get("$.payload.content", "variant")
    text_of = lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    texts = F.when(F.schema_of_variant(content) == "STRING", F.array(get("$.payload.content"))).otherwise(F.transform(F.try_variant_get(content, "$", "array<variant>"), text_of))
    shim = lambda t: F.regexp_replace(t, r"(?U)^\s+", "").rlike("^(?:" + "|".join(f"\\Q{s}\\E" for s in SHIMS) + ")")
    seen = F.coalesce(F.exists(texts, lambda t: visible(t) & ~F.coalesce(shim(t), F.lit(True))), F.lit(False))
    kind, part = get("$.type"), get("$.payload.type")
    is_message = F.coalesce((kind == "response_item") & (part == "message"), F.lit(False))
    lines = parsed.select(
        "session_file", "line_no", get("$.payload.turn_id").alias("own"), is_message.alias("message"),
        F.when(kind == "turn_context", get("$.payload.turn_id")).alias("context"), F.when(is_message, plain_role(get("$.payload.role"))).alias("role"), F.when(is_message, seen).alias("seen"),
    ).where("message or context is not null").distinct()
    carried = last_known(lines, ["session_file"], "line_no", "context", "carried")
    return carried.where("message").select("session_file", "line_no", F.coalesce("own", "carried").alias("turn_id"), "role", "seen")


def unanswered_turns(codex: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(session_file, turn_id) of turns with a visible user message and no visible assistant message."""
    keys = ["session_file", "turn_id"]
    own = checkpoint(codex_messages(codex).where("turn_id is not null and seen").select(*keys, F.lit(None).cast("int").alias("position"), F.col("line_no").cast("bigint").alias("at"), F.lit("").alias("tie"), "role", "seen"))
    said = block_summaries(own, keys, block_rows, turns=True).groupBy(*keys).agg(F.sum("users").alias("users"), F.sum("answers").alias("answers"))
    return said.where("users > 0 and answers = 0").select(*keys)


def dropped(messages: DataFrame, conversations: DataFrame, codex: DataFrame) -> DataFrame:
    """(kind, owner_id, turn_id): broken conversations and unanswered Codex turns."""
    own = broken_conversations(messages, conversations).select(F.lit("conversation").alias("kind"), F.col("conversation_id").alias("owner_id"), F.lit("").alias("turn_id"))
    turns = unanswered_turns(codex).select(F.lit("codex_turn").alias("kind"), F.col("session_file").alias("owner_id"), "turn_id")
    return own.unionByName(turns)


def reply_order(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conversation_id, id, step, depth, cyclic) of rows (conversation_id, id, parent_id, at) that name their parents.

    step is a row's place in the order of Kahn's algorithm: of the rows whose parent has come, the one of the least ``at``
    (null first) and id is next. Nodes in or behind a cycle have cyclic true and no step. A parent that is not there counts
    as none; repeated rows count once.

    Conversations of up to ``block_rows`` rows are walked in one task each. The order of larger ones is that of their
    rows' ways: of the keys (at, id) from the root to the row, those that are greater than all that follow them. Ways are
    put together by pointer doubling over joins; they have one key where replies come later than what they answer.
    """
    rows = checkpoint(rows.groupBy("conversation_id", "id").agg(F.min("parent_id").alias("parent_id"), F.min("at").alias("at")))
    sizes = rows.groupBy("conversation_id").agg(F.count("*").alias("n"))
    large = checkpoint(sizes.where(F.col("n") > block_rows))
    small = rows.join(large, "conversation_id", "left_anti")
    schema = T.StructType.fromDDL("conversation_id STRING, id STRING, step BIGINT, depth BIGINT, cyclic BOOLEAN")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def steps() -> Iterator[tuple]:
            for key, own in _clusters(batches, 1):
                place = {r[1]: i for i, r in enumerate(own)}
                parents = [-1 if r[2] is None else place.get(r[2], -1) for r in own]
                depth, step = [0] * len(own), [None] * len(own)
                for n, i in enumerate(kahn(parents, [(r[3] is not None, r[3] or 0, r[1] or "") for r in own])):
                    depth[i], step[i] = (depth[parents[i]] + 1 if parents[i] >= 0 else 0), n
                yield from ((*key, r[1], step[i], depth[i], step[i] is None) for i, r in enumerate(own))

        return _batches(steps(), arrow)

    done = small.repartition("conversation_id").sortWithinPartitions("conversation_id").select("conversation_id", "id", "parent_id", "at").mapInArrow(run, schema)
    most = large.agg(F.max("n")).head()[0]
    if most is None:
        return done
    big = rows.join(large, "conversation_id", "left_semi")
    held = big.select("conversation_id", F.col("id").alias("parent_id"), F.lit(True).alias("held"))
    up = F.when(F.col("held"), F.col("parent_id"))
    key = F.struct(F.col("at").isNotNull().alias("known"), F.coalesce("at", F.lit(0)).cast("bigint").alias("at"), F.coalesce("id", F.lit("")).alias("id"))
    state = big.join(held, ["conversation_id", "parent_id"], "left").select("conversation_id", "id", up.alias("up"), up.isNotNull().cast("bigint").alias("hops"), F.array(key).alias("way"))
    state = checkpoint(state)
    for _ in range(int(most).bit_length() + 1):
        over = state.select("conversation_id", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("way").alias("way2"))
        before = F.filter(F.coalesce("way2", F.array().cast(state.schema["way"].dataType)), lambda k: k > F.col("way")[0])
        state = checkpoint(state.join(over, ["conversation_id", "up"], "left").select("conversation_id", "id", F.col("up2").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.concat(before, "way").alias("way")))
        if state.where("up is not null").isEmpty():
            break
    cyclic = F.col("up").isNotNull()
    string = F.array_join(F.transform("way", lambda k: sortable(F.when(k["known"], k["at"]), k["id"], sizes=(True,))), "\0\0")
    placed = state.where(~cyclic).select("conversation_id", "id", "hops", F.when(F.col("way")[0]["known"], F.col("way")[0]["at"]).alias("top"), string.alias("way"), F.lit(1).alias("one"))
    placed = with_block(checkpoint(placed), ["conversation_id"], "top", block_rows, then="way")
    steps = running_sum(placed, ["conversation_id"], "block", ["way"], "one", "step")
    own = steps.select("conversation_id", "id", "step", F.col("hops").alias("depth"), F.lit(False).alias("cyclic"))
    lost = state.where(cyclic).select("conversation_id", "id", F.lit(None).cast("bigint").alias("step"), F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("cyclic"))
    return done.unionByName(own).unionByName(lost)


def export_order(exports: DataFrame) -> DataFrame:
    """(rec_id, version, root, node_id, step, depth, cyclic): the nodes of every exported conversation in the order of its reply tree.

    ``at`` is the place in the record, as the trees are walked before any time is read; an export delivered twice gives
    its rows once.
    """
    nodes = chatgpt_tables(exports, CHATGPT_LINKS)["nodes"]
    own = ["rec_id", "version", "root"]
    owner = F.concat_ws("/", *own)
    order = reply_order(nodes.select(owner.alias("conversation_id"), F.col("node_id").alias("id"), F.col("parent_key").alias("parent_id"), F.col("seq").cast("bigint").alias("at")))
    part = lambda i, t: F.split_part("conversation_id", F.lit("/"), F.lit(i)).cast(t)
    return order.select(part(1, "bigint").alias("rec_id"), part(2, "bigint").alias("version"), part(3, "int").alias("root"), F.col("id").alias("node_id"), "step", "depth", "cyclic")
