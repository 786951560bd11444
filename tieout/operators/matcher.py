"""Label rules matched by an automaton: all needles that a label holds are found in one pass over its letters.

The time of a label grows with its length and the needles found in it, not with the number of rules. A task builds the automaton
once from the rules, which are a dimension of checked size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.operators.rules import FOOTNOTE_TIER, PRIORITY_TIER, STATEMENT_TIER
from tieout.session import bounded_batches

#: Rules beyond so many bytes are no dimension to be sent to all tasks.
MOST_RULE_BYTES = 64 << 20
#: (tier, scope, needle, key, order).
Rule = tuple[int, str | None, str, str, int]


class RuleMatcher:
    """The best rule for a label under its context and statement.

    A label in a footnote block, told by the opening words of its context, is matched by that block's rules alone. Else
    priorities come first, in order, then the statement's own rules, the longest needle first; ties by order and key.
    """

    def __init__(self, rules: list[Rule]):
        self.blocks: dict[str, tuple] = {}
        by_needle: dict[str, dict[tuple, tuple]] = {}
        for tier, scope, needle, key, nth in rules:
            if needle is None:
                continue
            short = -len(needle)
            if tier == FOOTNOTE_TIER and scope is not None:
                rank = (short, nth, scope)
                self.blocks[scope] = min(rank, self.blocks.get(scope, rank))
            place = (tier, None if tier == PRIORITY_TIER else scope)
            order = (tier, nth if tier == PRIORITY_TIER else short, nth, key)
            own = by_needle.setdefault(needle, {})
            own[place] = min(order, own.get(place, order))
        self.block_lengths = sorted({len(b) for b in self.blocks})
        self.everywhere = by_needle.pop("", {})
        self.automaton = ahocorasick.Automaton()
        for needle, own in by_needle.items():
            self.automaton.add_word(needle, own)
        if by_needle:
            self.automaton.make_automaton()

    def block_of(self, context: str | None) -> str | None:
        found = [context[:n] for n in self.block_lengths if context is not None and context[:n] in self.blocks]
        return min(found, key=self.blocks.__getitem__, default=None)

    def best(self, label: str | None, context: str | None, statement: str | None) -> str | None:
        if label is None:
            return None
        block = self.block_of(context)
        places = [(PRIORITY_TIER, None), (STATEMENT_TIER, statement)] if block is None else [(FOOTNOTE_TIER, block)]
        hits = [self.everywhere, *(own for _, own in self.automaton.iter(label))] if len(self.automaton) else [self.everywhere]
        return min((own[p] for own in hits for p in places if p in own), default=(None,))[-1]


def _keys(batches: Iterator[pa.RecordBatch], rules: list[Rule]) -> Iterator[pa.RecordBatch]:
    matcher = RuleMatcher(rules)
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_label", "_context", "_statement")]
        found = pa.array([matcher.best(*x) for x in zip(*columns)], pa.string())
        kept = [c for c in batch.schema.names if c not in ("_label", "_context", "_statement")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, "canonical_key"])


def match_rules(rows: DataFrame, aliases: DataFrame, label: Column, context: Column, statement: Column) -> DataFrame:
    """rows with canonical_key, null where no rule fits; none of the columns may be called _label, _context or _statement."""
    dim = aliases.select("tier", F.lower("scope").alias("scope"), "needle", "canonical_key", "ord")
    size = dim.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("needle"), F.lit(0)) + F.octet_length("canonical_key") + 32), F.lit(0))).first()[0]
    if size > MOST_RULE_BYTES:
        raise ValueError(f"rules of {size} bytes are more than {MOST_RULE_BYTES}")
    rules = [tuple(r) for r in dim.collect()]
    asked = bounded_batches(rows).select("*", F.lower(F.trim(label)).alias("_label"), F.lower(context).alias("_context"), statement.alias("_statement"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "canonical_key string"])
    return asked.mapInArrow(partial(_keys, rules=rules), ddl)
