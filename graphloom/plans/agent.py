"""The agent: tools over the engine's tables behind phase gates, and a loop that a model or a script drives."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import retrieval as T
from ..operators.relational import ends
from ..operators.views import Views
from .control import TRANSITIONS, Session

_log = logging.getLogger(__name__)


@dataclass
class Trace:
    """What was done for one question, ready to be stored."""

    question: str
    steps: list[dict] = field(default_factory=list)

    def add(self, tool: str, args: dict, seen: object, ok: bool = True) -> None:
        self.steps.append({"step": len(self.steps), "tool": tool, "args": json.dumps(args, sort_keys=True, default=str), "seen": json.dumps(seen, default=str)[:500], "ok": ok})

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.question, *s.values()) for s in self.steps], "question string, step int, tool string, args string, seen string, ok boolean")


class Tools:
    """Each tool returns a few rows as plain values; what it read is noted in the session."""

    def __init__(self, views: Views, session: Session, trace: Trace, scope: T.Scope | None = None):
        self.v, self.session, self.trace, self.scope = views, session, trace, scope or T.Scope()
        self.collected: list[str] = []

    def __call__(self, tool: str, **args) -> object:
        """Runs a tool that the phase allows; a refusal or an error is a result, not an exception."""
        if not self.session.allow(tool):
            seen, ok = {"error": f"{tool} isn't allowed in phase {self.session.phase}"}, False
        else:
            try:
                seen, ok = getattr(self, f"_{tool}")(**args), True
            except (TypeError, ValueError, AttributeError) as e:
                seen, ok = {"error": str(e)}, False
        self.trace.add(tool, args, seen, ok)
        _log.debug("%s %s %s", tool, args, ok)
        return seen

    def _note(self, chunks: list[str]) -> list[str]:
        self.collected = list(dict.fromkeys([*self.collected, *chunks]))
        return chunks

    def _read(self, chunks: list[str]) -> None:
        self.session.read += [c for c in chunks if c not in self.session.read]

    def _inside(self) -> DataFrame:
        return self.scope.chunks(self.v.files, self.v.chunks)

    # session, guard and scope
    def _skip_guard(self) -> str:
        self.session.advance("scope")
        return "scope"

    def _guard_relevance(self, question: str) -> dict:
        self.session.advance("guard")
        return {"refusal": M.guard(None, question)}

    def _detect_followup(self, question: str, history: list = ()) -> dict:
        return {"follow_up": M.is_follow_up(None, question, [tuple(h) for h in history])}

    def _skip_scope(self) -> str:
        self.session.advance("retrieval")
        return "retrieval"

    def _set_scope(self, authors=(), titles=(), traditions=(), domains=()) -> dict:
        scope = T.Scope(tuple(authors), tuple(titles), tuple(traditions), tuple(domains))
        if not scope.texts(self.v.files).limit(1).count():
            return {"error": f"nothing fits {scope.describe()}"}
        self.scope = scope
        self.session.advance("retrieval")
        return {"scope": scope.describe()}

    def _list_available_sources(self) -> list:
        return [r.asDict() for r in self.v.files.orderBy("text_id").limit(100).collect()]

    # retrieval
    def _search_vectors(self, vec_id: int, k: int = 10) -> list:
        q = self.v.table("embeddings").filter(F.col("vec_id") == vec_id).select(F.transform("embedding", lambda x: x.cast("double")).alias("q"))
        found = T.scoped_vector_top_k(self.v.ec, self._inside(), q, k).collect()
        self._note([r.chunk_id for r in found])
        return [(r.chunk_id, round(r.score, 6)) for r in found]

    def _search_community_reports(self, vec_id: int, k: int = 5) -> list:
        q = self.v.table("embeddings").filter(F.col("vec_id") == vec_id).select(F.transform("embedding", lambda x: x.cast("double")).alias("q"))
        return [(r.comm_id, r.cited[:8]) for r in T.report_top_k(self.v.reports, q, k, self._inside()).collect()]

    def _read_community_summary(self, comm_id: int) -> dict | None:
        r = self.v.comms.filter(F.col("comm_id") == comm_id).select("comm_id", "size", "summary", "top_terms").first()
        return r and r.asDict()

    def _get_chunk_content(self, chunk_ids: list[str]) -> list:
        found = self.v.chunks.filter(F.col("chunk_id").isin(list(chunk_ids))).join(self._inside(), "chunk_id", "left_semi").select("chunk_id", "content").orderBy("chunk_id").collect()
        self._read([r.chunk_id for r in found])
        self._note([r.chunk_id for r in found])
        return [(r.chunk_id, r.content) for r in found]

    def _get_collected_chunks(self) -> list[str]:
        return self.collected

    def _get_entities_from_chunks(self, chunk_ids: list[str], k: int = 20) -> list:
        t = self.v.tg.filter(F.col("chunk_id").isin(list(chunk_ids)))
        return [(r.entity, r.n) for r in ends(t).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(k).collect()]

    def _get_seed_entities_for_communities(self, comm_ids: list[int], k: int = 10) -> list:
        d = ends(self.v.tg, out="node_id").groupBy("node_id").agg(F.count("*").alias("degree")).join(self.v.mem.filter(F.col("comm_id").isin(list(comm_ids))), "node_id")
        return [(r.node_id, r.comm_id, r.degree) for r in d.orderBy(F.desc("degree"), "node_id").limit(k).collect()]

    def _advance_to_traversal(self) -> str:
        self.session.advance("traversal")
        return "traversal"

    # traversal
    def _expand_node(self, node: str, k: int = 15) -> list:
        self.session.visit(node)
        return [(r.neighbour, r.p, r.n) for r in expand_node(self.v.tg, node, k).collect()]

    def _backtrack(self) -> str | None:
        return self.session.backtrack()

    def _get_traversal_state(self) -> dict:
        return {"path": self.session.path, "collected": len(self.collected)}

    def _advance_to_synthesis(self) -> str:
        self.session.advance("synthesis")
        return "synthesis"

    def _synthesize_answer(self, text: str, cites: list[str], before: list[str] = ()) -> dict:
        """The gate: something is cited, all of it was read, and after earlier answers something is new."""
        if not cites or not set(cites) <= set(self.session.read) or (before and set(cites) <= set(before)):
            return {"error": "cite chunks that were read, and after an earlier answer a new one"}
        self.session.advance("done")
        return {"answer": text, "cites": list(cites)}

    def _sequential_thinking(self, text: str) -> int:
        return self.session.think(text)


def expand_node(triples: DataFrame, node: str, k: int = 15) -> DataFrame:
    """neighbour, p, n: the strongest out-neighbours of a node."""
    return triples.filter(F.col("s") == node).groupBy(F.col("o").alias("neighbour"), "p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "neighbour", "p").limit(k)


def path_edges(steps: DataFrame, key: str, at: str, node: str) -> DataFrame:
    """key, at, from_node, to_node: a walk's steps as the edges to show."""
    from pyspark.sql.window import Window

    nxt = F.lead(node).over(Window.partitionBy(key).orderBy(at))
    return steps.select(key, at, F.col(node).alias("from_node"), nxt.alias("to_node")).filter("to_node is not null")


def traces(log: DataFrame, key: str, at: str, what: str) -> DataFrame:
    """One row a key: its steps in order, as text."""
    s = F.array_sort(F.collect_list(F.struct(at, what)))
    return log.groupBy(key).agg(F.array_join(F.transform(s, lambda x: F.concat_ws(":", x[at].cast("string"), x[what])), " ").alias("trace"))


#: Chooses the next (tool, arguments) from the question, the phase and what was seen so far; None ends the run.
Policy = Callable[[str, str, list[dict]], tuple[str, dict] | None]


class Agent:
    """Runs a policy to an answer.  A call repeated without news, or a phase that lasts too long, is moved on by force."""

    def __init__(self, views: Views, policy: Policy, most_calls: int = 40, stall: int = 3, memory: int = 5):
        self.v, self.policy, self.most_calls, self.stall = views, policy, most_calls, stall
        self.memory, self.history = memory, []

    def reset(self) -> None:
        self.history = []

    def ask(self, question: str, emit: Callable[[str, dict], None] = lambda kind, data: None) -> dict:
        """answer, cites, trace; emit gets ("status", ...) at each step and ("complete", ...) at the end."""
        session, trace = Session(), Trace(question)
        tools = Tools(self.v, session, trace)
        out: dict = {"answer": None, "cites": []}
        last, same = None, 0
        while len(trace.steps) < self.most_calls and session.phase != "done":
            call = self.policy(question, session.phase, trace.steps)
            if call is None:
                break
            same = same + 1 if call == last else 0
            last = call
            if same >= self.stall:  # no news: on to the next phase, or the end
                nxt = [p for p in TRANSITIONS[session.phase] if p != "done"]
                trace.add("moved_on", {"from": session.phase}, nxt[-1:] or None)
                if not nxt:
                    break
                session.advance(nxt[-1])
                same, last = 0, None
                continue
            seen = tools(call[0], **call[1])
            emit("status", {"tool": call[0], "phase": session.phase})
            if call[0] == "synthesize_answer" and isinstance(seen, dict) and "answer" in seen:
                out = seen
        if out["answer"] is not None:
            self.history = [*self.history, (question, out["answer"])][-self.memory :]
        out = out | {"trace": trace, "phase": session.phase, "calls": len(trace.steps)}
        emit("complete", {"answer": out["answer"], "cites": out["cites"]})
        return out
