"""Questions in words: prompts from a schema, and the loop that turns an answer into a valid query.

The model is any callable from a list of messages to text; nothing here needs one to be installed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from ..errors import GraphError, QueryError
from ..functions.types import QUERY_HANDLER, Registry, storage_type
from ..operators.introspect import LiveSchema
from . import dsl

Model = Callable[[Sequence[Mapping[str, str]]], str]

RULES = (
    "Answer with one JSON object and nothing else.",
    "Use only labels, relations and properties of the schema.",
    "Bind every node to an alias of its own; a traversal without `from` goes out from the start node.",
    "Filters are joined by AND. Compare words with `eq`, `contains` and their `_ci` forms; use `type` as the schema gives it.",
    "`eq` means one thing and other operators many, unless `cardinality` says so.",
    "Counting, summing and the like go into `return` with `aggregate`; plain fields beside them belong into `group_by` too.",
    "Group times by `date_part`: year, quarter, month, day or hour.",
    "Depth is for chains of one relation; it starts at 1.",
)


#: (label, property) to the storage type that an ontology declares.
Types = Mapping[tuple[str, str], str]


def field_handler(types: Types, label: str, prop: str) -> str | None:
    """The field type that compares a declared property."""
    return QUERY_HANDLER[storage_type(types[(label, prop)])] if (label, prop) in types else None


def type_hints(schema: LiveSchema, types: Types, registry: Registry | None = None) -> list[str]:
    """What the field types of a schema can do, one line each."""
    registry = registry or Registry()
    used = {field_handler(types, n.label, p.name) for n in schema.nodes for p in n.properties} - {None}
    return [registry.get(h).prompt_hint() for h in sorted(used)]


def schema_text(schema: LiveSchema, types: Types | None = None) -> str:
    """Nodes and relations; a property that a field type compares is marked by it, as in `name String <Keyword>`."""
    mark = lambda label, name: f" <{h}>" if (h := field_handler(types or {}, label, name)) else ""
    lines = ["Nodes:"]
    for n in schema.nodes:
        props = ", ".join(f"{p.name} {p.type}{mark(n.label, p.name)}" + (f" [{' | '.join(p.values)}]" if p.values else "") for p in n.properties)
        lines.append(f"  {n.label} ({props})")
    lines.append("Relations:")
    lines += [f"  ({r.source})-[{r.name}]->({r.target})" + (f" ({', '.join(p.name + ' ' + p.type for p in r.properties)})" if r.properties else "") for r in schema.relations]
    return "\n".join(lines)


def aliases(schema: LiveSchema) -> dict[str, str]:
    """A short alias for each label: its capitals, or its first letter, with a number if that is taken."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for n in schema.nodes:
        caps = "".join(c for c in n.label if c.isupper()).lower() or n.label[:1].lower() or "n"
        name, i = caps, 2
        while name in taken:
            name, i = f"{caps}{i}", i + 1
        taken.add(name)
        out[n.label] = name
    return out


def paths(schema: LiveSchema, longest: int = 2) -> list[str]:
    """Label paths of one and two relations, as hints on how to join."""
    one = [(r.source, r.name, r.target) for r in schema.relations]
    out = [f"{a} -{r}-> {b}" for a, r, b in one]
    if longest > 1:
        out += [f"{a} -{r}-> {b} -{s}-> {d}" for a, r, b in one for c, s, d in one if b == c and (a, r, b) != (c, s, d)]
    return out


def system_prompt(schema: LiveSchema, hints: Sequence[str] = (), types: Types | None = None, registry: Registry | None = None) -> str:
    given = ", ".join(f"{label}: {a}" for label, a in aliases(schema).items())
    parts = ["You turn questions about a graph into JSON queries.", schema_text(schema, types), "Paths:\n" + "\n".join("  " + p for p in paths(schema)), "Aliases: " + given]
    if told := type_hints(schema, types or {}, registry):
        parts.append("Give a filter on a marked property the mark as its `type`. Operators by type:\n" + "\n".join("  " + t for t in told))
    parts.append("Rules:\n" + "\n".join(f"{i}. {r}" for i, r in enumerate([*RULES, *hints], 1)))
    example = {"start": {"label": "Person", "alias": "p"}, "traversals": [], "filters": [{"field": "p.name", "op": "eq_ci", "value": "ann"}], "return": [{"field": "p.name"}], "limit": 10}
    parts.append("Shape: " + json.dumps(example))
    return "\n\n".join(parts)


def query_prompt(question: str) -> str:
    return f"Question: {question}\nQuery:"


def suggest_prompt(schema: LiveSchema, sample: str) -> str:
    """Asks for types and properties that a text has and the schema lacks; nothing may be taken away."""
    return "\n\n".join(
        ["Extend this schema by what the text below needs. Only add; never rename or remove.", schema_text(schema), "Text:\n" + sample,
         'Answer with {"entity_types": [...], "relation_types": [...]} and nothing else.']
    )


def json_object(text: str) -> dict:
    """The first balanced JSON object in a text."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            got, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    raise QueryError("there is no JSON object in the answer")


def masked(v: Any, longest: int = 8) -> Any:
    """A value for a trace: long lists of numbers are told by their length."""
    if isinstance(v, Mapping):
        return {k: masked(x, longest) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        if len(v) > longest and all(isinstance(x, (int, float)) for x in v):
            return f"<{len(v)} numbers>"
        return [masked(x, longest) for x in v]
    return v


@dataclass(frozen=True)
class Translation:
    query: dsl.Query
    attempts: int
    messages: tuple[Mapping[str, str], ...]


def question_to_query(question: str, schema: LiveSchema, model: Model, check: Callable[[dsl.Query], Any] | None = None, max_repairs: int = 1, prefix_label: str | None = None, prefix_index: str | None = None, hints: Sequence[str] = (), types: Types | None = None, registry: Registry | None = None) -> Translation:
    """Asks for a query and, as long as it is not valid, for a better one. The tenant's prefixes are set, whatever the answer says."""
    messages: list[Mapping[str, str]] = [{"role": "system", "content": system_prompt(schema, hints, types, registry)}, {"role": "user", "content": query_prompt(question)}]
    for attempt in range(1 + max_repairs):
        answer = model(messages)
        messages.append({"role": "assistant", "content": answer})
        try:
            q = replace(dsl.parse(json_object(answer)), prefix_label=prefix_label, prefix_index=prefix_index)
            dsl.validate(q)
            if check is not None:
                check(q)
            return Translation(q, attempt + 1, tuple(messages))
        except GraphError as e:
            if attempt == max_repairs:
                raise
            messages.append({"role": "user", "content": f"That does not work: {e}. Answer with the corrected JSON object."})
    raise AssertionError("unreachable")


def answer(question: str, rows: Sequence[Mapping[str, Any]], model: Model) -> str:
    """A sentence that answers a question by rows."""
    table = "\n".join(json.dumps(masked(dict(r)), ensure_ascii=False, default=str) for r in rows)
    return model([{"role": "system", "content": "Answer the question by these rows alone. Say so if they do not tell."}, {"role": "user", "content": f"{question}\n\n{table}"}]).strip()
