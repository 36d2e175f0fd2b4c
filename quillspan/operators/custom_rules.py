"""Rules of a user's own: Python functions from a candidate to evidence, run where the candidates are."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.operators.review import MOST_FAILURE_TEXT, canonical_json
from quillspan.sources.files import check_rule


@dataclass(frozen=True)
class CustomRule:
    """A rule and its builder. `build` gets a candidate (file_path, kind, start_line, end_line, id, text) and returns
    evidence that JSON can write, or None to abstain."""

    rule_id: str
    scope: str
    message: str
    build: Callable[[dict[str, Any]], Any]
    category: str = "maintainability"


@dataclass
class RuleBook:
    """The custom rules of a run, checked before any job starts."""

    taken: Iterable[str] = ()
    rules: dict[str, CustomRule] = field(default_factory=dict)

    def add(self, rule: CustomRule) -> CustomRule:
        """Registers a rule; its name must be new, also among the built-in rules, whose builders are never replaced."""
        check_rule(rule.rule_id, {"scope": rule.scope, "message": rule.message, "category": rule.category})
        if rule.rule_id in self.rules or rule.rule_id in set(self.taken):
            raise ValueError(f"rule {rule.rule_id!r} is there already")
        if not callable(rule.build) or inspect.iscoroutinefunction(rule.build) or inspect.isasyncgenfunction(rule.build):
            raise ValueError(f"rule {rule.rule_id!r} needs a plain function as its builder")
        self.rules[rule.rule_id] = rule
        return rule

    def rule(self, rule_id: str, scope: str, message: str, category: str = "maintainability"):
        """Decorates a builder and registers it."""

        def keep(build):
            self.add(CustomRule(rule_id, scope, message, build, category))
            return build

        return keep

    def rows(self) -> list[tuple]:
        return [(r.rule_id, r.scope, r.category, r.message) for r in self.rules.values()]


def outcome(rule: CustomRule, candidate: dict[str, Any]) -> tuple[str | None, str | None] | None:
    """(evidence as JSON, error) of one candidate; None if the rule abstains. Whatever goes wrong is the candidate's failure."""
    try:
        made = rule.build(candidate)
        if made is None:
            return None
        if inspect.isawaitable(made):
            made.close() if inspect.iscoroutine(made) else None
            raise TypeError("evidence must not be awaitable")
        text = canonical_json(made)
        json.loads(text, parse_constant=_no_constant)
        return text, None
    except Exception as problem:
        return None, " ".join(f"{type(problem).__name__}: {problem}".split())[:MOST_FAILURE_TEXT]


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def custom_evidence(candidates: DataFrame, book: RuleBook) -> DataFrame:
    """(id, rule_id, evidence, error) of the candidates (file_path, kind, start_line, end_line, id, text) for which a custom rule does not abstain.

    A builder that fails for one candidate goes on with the next; rows are taken as they come, batch by batch.
    """
    by_scope: dict[str, list[CustomRule]] = {}
    for rule in book.rules.values():
        by_scope.setdefault(rule.scope, []).append(rule)
    columns = ["file_path", "kind", "start_line", "end_line", "id", "text"]

    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for candidate in batch.to_pylist():
                for rule in by_scope.get(candidate["kind"], ()):
                    met = outcome(rule, dict(candidate))
                    if met is not None:
                        out.append((candidate["id"], rule.rule_id, *met))
            kinds = pa.schema([(c, pa.string()) for c in ("id", "rule_id", "evidence", "error")])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], schema=kinds)

    asked = candidates.where(candidates["kind"].isin(*by_scope)) if by_scope else candidates.where("false")
    return asked.select(*columns).mapInArrow(rows, "id string, rule_id string, evidence string, error string")
