"""What a text model is asked, by task: our own wording, put together from the task's request, its context and the text."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from dolomite import lexicon

JSON_ONLY = "Answer with JSON alone."
REQUESTS = {
    "extract": 'List every design rule of the text as a JSON list of objects with rule_text, rule_type, constraints, applicability, confidence (0 to 1) and supporting_quote. Rule types: {classes}.',
    "bulk": 'List every design rule of the text, word by word, as {{"rules": [{{"text": ..., "confidence_score": ...}}]}}.',
    "single": "Give the text's one most important design rule as a JSON object with rule_text, rule_type, confidence and supporting_quote.",
    "enhance": "Improve this rule with the help of similar ones, and answer with a JSON object of the same fields.",
    "classify": "Name the one class that the rule belongs to: {classes}.",
    "intent": "Say whether the rule can be measured (is_quantifiable), its rule_intent (type, requires_geometry, requires_tolerance) and its geometry_relation (from, to).",
    "geometry": "Give the right side of the rule's distance as an expression, alone.",
    "tolerance": "Write the rule's tolerance as Tolerance(...), Limits(...), Max(...), Min(...) or GDT(...), alone.",
    "attribute": "Write the rule as Object.Attribute, operator and value, with names of the schema alone; null where it has none.",
    "formalise": "Write the rule as JSON with formalism (equation, AST or null), equation, ast and reasoning.",
    "validate": 'Check the formal rule against the schema; answer {{"is_valid": ..., "issues": [...]}}.',
    "normalise": "Rewrite the rule in the schema's terms, one line a rule, alone.",
}


def assembled(task: str, text: str, context: Mapping[str, str] | None = None) -> str:
    """The request, what is known (name: value, blank ones left out), and the text. A document's name and place are no part of it."""
    request = REQUESTS[task].format(classes=", ".join([*dict.fromkeys(lexicon.RULE_TYPE_DOMAINS.values())]))
    known = [f"{k}: {v}" for k, v in (context or {}).items() if v.strip()]
    return "\n\n".join([request, *([] if task in ("geometry", "tolerance", "attribute", "classify", "normalise") else [JSON_ONLY]), *known, text])


@dataclass(frozen=True)
class Prompted:
    """A provider of a function from prompt to answer."""

    call: Callable[[str], str]
    context: tuple[tuple[str, str], ...] = ()

    def complete(self, task: str, text: str) -> str:
        return self.call(assembled(task, text, dict(self.context)))
