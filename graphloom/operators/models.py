"""Language-model clients behind a protocol: prompts, replies, checks before a run, and errors that must stop one."""

from __future__ import annotations

import json
from typing import Protocol

#: Messages and class names that no retry mends.
FATAL = ("authentication", "unauthorized", "invalid api key", "permission", "insufficient_quota", "quota exceeded", "model not found", "does not exist", "billing")
IRRELEVANT = "This question is outside what the collection covers."
UNSAFE = "This question can't be answered here."
GREETING = "Ask about the works in the collection."


class Client(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class FatalModelError(RuntimeError):
    """Raised where going on would fail for every chunk."""


def is_fatal(error: BaseException) -> bool:
    seen = f"{type(error).__name__} {error}".lower()
    return any(x in seen for x in FATAL) or getattr(error, "status_code", None) in (401, 402, 403, 404)


def preflight(client: Client) -> None:
    """One small call before many: raises FatalModelError if the client can't answer at all."""
    try:
        reply = client.complete("Reply with JSON.", '{"ping": true}')
    except Exception as e:
        raise FatalModelError(f"the model can't be reached: {e}") from e
    if not isinstance(reply, str) or not reply.strip():
        raise FatalModelError("the model gave an empty reply")


def parse(reply: str) -> dict:
    """The JSON object of a reply, fenced or amid prose; an empty one if there is none."""
    low, high = reply.find("{"), reply.rfind("}")
    try:
        got = json.loads(reply[low : high + 1]) if low >= 0 else {}
    except json.JSONDecodeError:
        return {}
    return got if isinstance(got, dict) else {}


def extraction_prompt(chunks: list[tuple[str, str]], types: tuple[str, ...]) -> tuple[str, str]:
    system = f"From each passage take the statements it makes as subject, predicate, object. Types are one of: {', '.join(types)}. Reply with one JSON object."
    shape = '{"chunks": [{"chunk_id": "", "triples": [{"subject": "", "subject_type": "", "predicate": "", "object": "", "object_type": ""}]}]}'
    return system, f"Shape: {shape}\n" + json.dumps([{"chunk_id": i, "text": t} for i, t in chunks], ensure_ascii=False)


def judge_prompt(triples: list[tuple[str, str, str]]) -> tuple[str, str]:
    system = "Decide for each statement whether it is worth keeping: specific, understandable alone, about the subject matter. Reply with one JSON object."
    rows = [{"triple_id": k, "subject": s, "predicate": p, "object": o} for k, (s, p, o) in enumerate(triples)]
    return system, 'Shape: {"triples": [{"triple_id": 0, "keep": true, "reason": ""}]}\n' + json.dumps(rows, ensure_ascii=False)


class ModelExtractor:
    """The extractor protocol over a client.  A reply that doesn't parse holds nothing; a fatal error goes through."""

    def __init__(self, client: Client, types: tuple[str, ...] = ("Concept", "Person", "Work", "Place")):
        self.client, self.types = client, types

    def _ask(self, prompt: tuple[str, str]) -> dict:
        try:
            return parse(self.client.complete(*prompt))
        except Exception as e:
            if is_fatal(e):
                raise FatalModelError(str(e)) from e
            return {}

    def typed(self, text: str) -> list[tuple[str, str, str, str, str]]:
        """subject, predicate, object and the types of both ends; unknown types fall back to the first."""
        kind = lambda x: x if x in self.types else self.types[0]
        rows = [t for c in self._ask(extraction_prompt([("0", text)], self.types)).get("chunks", []) for t in c.get("triples", [])]
        return [(str(t["subject"]), str(t["predicate"]), str(t["object"]), kind(t.get("subject_type")), kind(t.get("object_type"))) for t in rows if all(t.get(k) for k in ("subject", "predicate", "object"))]

    def triples(self, text: str) -> list[tuple[str, str, str]]:
        return [t[:3] for t in self.typed(text)]

    def keep(self, triples: list[tuple[str, str, str]]) -> list[bool | None]:
        said = {t.get("triple_id"): t.get("keep") for t in self._ask(judge_prompt(triples)).get("triples", [])}
        return [said.get(k) if isinstance(said.get(k), bool) else None for k in range(len(triples))]


def same_entity_judge(client: Client):
    """A judge of name pairs for `canonicalization`; what the reply leaves out isn't the same."""

    def judge(pairs: list[tuple[str, str]]) -> list[bool]:
        rows = [{"pair": k, "left": a, "right": b} for k, (a, b) in enumerate(pairs)]
        got = parse(client.complete("Say of each pair whether both labels name one and the same thing: spellings, abbreviations or titles of it, not kindred things. Reply with one JSON object.", 'Shape: {"pairs": [{"pair": 0, "same": true}]}\n' + json.dumps(rows, ensure_ascii=False)))
        same = {p.get("pair") for p in got.get("pairs", []) if p.get("same") is True}
        return [k in same for k in range(len(pairs))]

    return judge


def answer(client: Client | None, question: str, context: list[str], history: list[tuple[str, str]] = ()) -> str:
    """Prose over numbered passages; without a client, the first of them with their numbers."""
    numbered = "\n\n".join(f"[{k}] {t}" for k, t in enumerate(context, 1))
    if client is None:
        return "\n".join(f"{t[:200]} [{k}]" for k, t in enumerate(context[:3], 1)) or "Nothing in the collection answers this."
    past = "".join(f"Earlier: {q}\n{a}\n" for q, a in list(history)[-5:])
    return client.complete("Answer from the numbered passages alone and cite them as [n]. Say so where they don't answer.", f"{past}{numbered}\n\nQuestion: {question}")


def guard(client: Client | None, question: str) -> str | None:
    """A refusal, or None if the question may be asked; a reply that doesn't parse lets it through."""
    if client is None:
        return None
    got = parse(client.complete("Is the question safe, and one that a library could answer? Reply with JSON.", 'Shape: {"relevant": true, "safe": true}\n' + question))
    return UNSAFE if got.get("safe") is False else IRRELEVANT if got.get("relevant") is False else None


def is_follow_up(client: Client | None, question: str, history: list[tuple[str, str]]) -> bool:
    """Whether it leans on what was said before: by the model, else by words that point back."""
    if not history:
        return False
    if client is not None:
        return parse(client.complete("Does the question only make sense after the earlier one? Reply with JSON.", f'Shape: {{"follow_up": true}}\nEarlier: {history[-1][0]}\nNow: {question}')).get("follow_up") is True
    words = question.lower().replace("?", " ").split()
    return len(words) <= 4 or bool({"it", "they", "them", "this", "that", "these", "those", "he", "she", "his", "her", "their", "more", "else"} & set(words))
