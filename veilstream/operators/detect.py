"""Pattern detectors: arrays of spans from a text column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.matching import matches
from veilstream.functions.spans import SPANS, empty, span
from veilstream.functions.validity import MODES, normalize_mode, valid
from veilstream.operators.rules import PII_RULES, SECRET_RULES, Rule


def apply_rule(text: Column, rule: Rule) -> Column:
    found = matches(text, rule.pattern, needs=rule.needs, gate=rule.gate)
    if rule.checked:
        found = F.filter(found, lambda m: valid(rule.kind, m["text"]))
    return F.transform(found, lambda m: span(m["start"], m["end"], m["text"], rule.label, rule.kind, "regex", rule.score, rule.reasons)).cast(SPANS)


def secret_spans(text: Column, mode: str | Column = "balanced", rules: Iterable[Rule] = SECRET_RULES) -> Column:
    """Secrets in rule order. A literal mode selects rules when the plan is built; a mode column selects per row."""
    if isinstance(mode, str):
        mode = mode if mode in MODES else "balanced"
        parts = [apply_rule(text, r) for r in rules if mode in r.modes]
    else:
        now = normalize_mode(mode)
        parts = [
            apply_rule(text, r) if len(r.modes) == len(MODES) else F.when(now.isin(*r.modes), apply_rule(text, r)).otherwise(empty()) for r in rules
        ]
    return F.concat(*parts)


def pii_spans(text: Column, rules: Iterable[Rule] = PII_RULES) -> Column:
    return F.concat(*[apply_rule(text, r) for r in rules])
