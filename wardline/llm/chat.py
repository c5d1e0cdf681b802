"""Chat formatting with a minimum-cost repair of the roles.

A legal conversation is an optional system turn, then user and assistant turns by turns, an assistant turn
at the end. Dynamic programming over this automaton, whose state is the role of the last turn written,
chooses for every turn of a conversation one of

  emit    write it under a role that may follow; another role than its own is a relabel
  merge   append it to the turn written last; under another role that is also a relabel

and writes empty turns where a legal one is missing in between or at the end. The sum of the costs is least;
among equal sums, at the last turn where they differ, emitting goes before merging, and then the roles in
the order system, user, assistant. Turns with an unknown or null role have to be relabelled. The repaired
sequence is rendered turn by turn.

Rows are dealt out by conversation and sorted, and tasks walk them in order; what a task holds is one
conversation, which as a rendered text is one row of the result and so has to fit one. Repairs depend on the
roles only and are remembered by sequence of roles.

Defined results: turns are taken by number, null last, then by role and text, so repeated turns stay; null
text is empty; rows with null conv_id are conversations of one turn each; the marks of the template inside a
text are broken up by a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROLES = ("system", "user", "assistant")
_NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

MERGE, INSERT, RELABEL = 1, 2, 3

SCHEMA = (
    "conv_id long, n_turns long, cost long, n_merged long, n_inserted long, n_relabelled long, "
    "n_rendered long, roles string, rendered string"
)


@lru_cache(None)
def bridge(state: str | None, role: str | None) -> tuple[str, ...] | None:
    """Fewest empty turns between a state and a turn of a role (None: the end); None if there is no way."""
    ways: list[tuple[str | None, tuple[str, ...]]] = [(state, ())]
    for _ in range(len(ROLES) + 1):
        for at, written in ways:
            if role in _NEXT[at] if role else at in (None, "assistant"):
                return written
        ways = [(step, (*written, step)) for at, written in ways for step in _NEXT[at]]
    return None


@lru_cache(100_000)
def repair(roles: tuple[str | None, ...]) -> tuple[int, tuple[tuple[str, tuple[int, ...]], ...], int, int, int]:
    """Cost, turns to write as (role, numbers of the turns in it), and how many merges, insertions, relabels."""
    best: dict[str | None, int] = {None: 0}
    steps: list[dict[str, tuple[int, str | None]]] = []
    for own in roles:
        found: dict[str, tuple[tuple[int, int, int], str | None]] = {}
        for state, cost in best.items():
            for rank, role in enumerate(ROLES):
                if (way := bridge(state, role)) is not None:
                    price = cost + INSERT * len(way) + RELABEL * (role != own)
                    key = (price, 0, -1 if state is None else ROLES.index(state))
                    if role not in found or key < found[role][0]:
                        found[role] = (key, state)
                if role == state:
                    key = (cost + MERGE + RELABEL * (role != own), 1, rank)
                    if role not in found or key < found[role][0]:
                        found[role] = (key, state)
        steps.append({role: (key[1], state) for role, (key, state) in found.items()})
        best = {role: key[0] for role, (key, _) in found.items()}
    ends = {state: cost + INSERT * len(bridge(state, None)) for state, cost in best.items()}
    state = min(ends, key=lambda s: (ends[s], -1 if s is None else ROLES.index(s)))
    total = ends[state]
    chosen: list[tuple[str, int, str | None]] = []
    for step in reversed(steps):
        merge, before = step[state]
        chosen.append((state, merge, before))
        state = before
    turns: list[tuple[str, list[int]]] = []
    merged = inserted = relabelled = 0
    last = None
    for i, (role, merge, before) in enumerate(reversed(chosen)):
        relabelled += role != roles[i]
        if merge:
            merged += 1
            turns[-1][1].append(i)
        else:
            way = bridge(before, role)
            inserted += len(way)
            turns += [(empty, []) for empty in way] + [(role, [i])]
        last = role
    way = bridge(last, None)
    inserted += len(way)
    turns += [(empty, []) for empty in way]
    return total, tuple((r, tuple(n)) for r, n in turns), merged, inserted, relabelled


def render(turns: tuple[tuple[str, tuple[int, ...]], ...], texts: list[str]) -> str:
    plain = lambda t: t.replace("<|", "< |").replace("|>", "| >")
    return "".join(f"<|im_start|>{role}\n{chr(10).join(plain(texts[i]) for i in held)}<|im_end|>\n" for role, held in turns)


def _finished(conv: int | None, roles: list[str | None], texts: list[str]) -> tuple:
    cost, turns, merged, inserted, relabelled = repair(tuple(r if r in ROLES else None for r in roles))
    names = ",".join(r for r, _ in turns)
    return conv, len(roles), cost, merged, inserted, relabelled, len(turns), names, render(turns, texts)


def format_chats(conversations: DataFrame) -> DataFrame:
    """Per conversation (conv_id, turn, role, text): the cost and kinds of its repair, and the rendered text."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    # conversations without an id are single rows: they need no common place
    place = F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))
    dealt = rows.withColumn("place", place).repartition("place")
    last = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, pa.string() if n in ("roles", "rendered") else pa.int64()) for n in names])
        done: list[tuple] = []
        now, roles, texts = None, [], []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if roles and (conv != now or conv is None):
                    done.append(_finished(now, roles, texts))
                    roles, texts = [], []
                now = conv
                roles.append(role)
                texts.append(text or "")
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], kind)
                done = []
        if roles:
            done.append(_finished(now, roles, texts))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], kind)

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return dealt.sortWithinPartitions(*last).select("conv_id", "role", "text").mapInArrow(run, SCHEMA)
