"""Groups of messages about one subject, and what has been said about each.

Two folds depend on the order of messages and are Arrow kernels; everything before
and after them is columns:

* ``assign``: a message joins the group that its subject matches best, or starts one;
  groups grow richer names and variants on the way. All names and variants are token
  sets of messages, so a message can only ever join a group of the connected component
  of its own set, where sets are linked that match each other or stand in one message.
  The sets are compared once each, by a join on their leading tokens; each component is
  then folded apart, in order, and groups are numbered afterwards by their seeds.
* ``lifecycle``: one ordered pass per group, all groups in parallel. It emits the
  group's whole state after each message, and the transitions, changes and conflicts
  that the message caused; histories are explodes of these, snapshots the last state
  in or before a batch.

Both folds read rows that Spark has sorted and hold the names of one component, or the
state of one group, never its messages. A component is one ordered task by definition of
the result (each assignment depends on all before it): where most subjects are alike
there is a giant one, whose fold takes as long as its messages are many.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive import schema as S
from missive.functions import text as T
from missive.functions.graph import components
from missive.functions.order import numbered_in_order, spread
from missive.operators.subject import CONTAINMENT_ACCEPT, COSINE_ACCEPT, COSINE_FLOOR
from missive.sources.tables import removed, written

ASSIGNED = "tenant string, seq long, seed_seq long, match_score double, match_tokens array<string>, weak_link boolean, seed boolean, kind string, display string, tokens array<string>"


#: sets whose match score may differ by rounding from the fold's are linked too
SLACK = 1e-6


def token_sets(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """(tenant, tokens, weights, mass, set_id): the distinct token sets of subjects and item titles, with their tokens' weights."""
    sets = rows.select("tenant", F.explode(F.array(F.col("subject")["tokens"], F.col("item_signature")["tokens"])).alias("tokens")).filter("tokens is not null").distinct()
    n = F.broadcast(idf.agg(F.max("n_subjects").alias("n"), F.max("distinctive_df").alias("cut")))
    flat = sets.select("tenant", "tokens", F.explode("tokens").alias("token")).join(idf.select("token", "idf", "df"), "token", "left").crossJoin(n)
    weight = F.coalesce("idf", F.log(F.col("n") + 1) + 1.0)
    one = F.struct("token", weight.alias("idf"), (F.coalesce("df", F.lit(0)) <= F.col("cut")).alias("rare"), (~F.col("token").isin(T.GENERIC_HEADS)).alias("specific"))
    sets = flat.groupBy("tenant", "tokens").agg(F.sort_array(F.collect_list(one)).alias("weights"))
    mass = F.aggregate("weights", F.lit(0.0), lambda total, w: total + w["idf"])
    return sets.withColumns({"mass": mass, "set_id": F.monotonically_increasing_id()})


def matching_sets(sets: DataFrame) -> DataFrame:
    """(a, b): the ids of ``token_sets`` of one tenant that match each other.

    A match shares COSINE_ACCEPT of the smaller mass at least, so among the tokens of
    the smaller set from the heaviest on until less than that is left, one is shared.
    """
    each = sets.select("tenant", "set_id", "mass", "weights", F.explode("weights").alias("w")).withColumn("token", F.col("w.token"))
    rest = Window.partitionBy("set_id").orderBy("w.idf", F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    leads = each.withColumn("rest", F.sum("w.idf").over(rest)).filter(F.col("rest") >= COSINE_ACCEPT * F.col("mass") * (1 - SLACK))
    side = lambda df, c: df.select("tenant", "token", *(F.col(n).alias(f"{n}_{c}") for n in ("set_id", "mass", "weights")))
    pairs = side(leads, "a").join(side(each, "b"), ["tenant", "token"]).filter(F.col("mass_a") <= F.col("mass_b") * (1 + SLACK)).filter("set_id_a <> set_id_b")
    names = F.transform("weights_b", lambda w: w["token"])
    pairs = pairs.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"), "mass_a", "mass_b", F.filter("weights_a", lambda w: F.array_contains(names, w["token"])).alias("shared"))
    both = F.aggregate("shared", F.lit(0.0), lambda total, w: total + w["idf"])
    cosine, containment = both / F.sqrt(F.col("mass_a") * F.col("mass_b")), both / F.least("mass_a", "mass_b")
    alike = (cosine >= COSINE_ACCEPT - SLACK) | ((containment >= CONTAINMENT_ACCEPT - SLACK) & (cosine >= COSINE_FLOOR - SLACK))
    telling = F.exists("shared", lambda w: w["specific"]) & ((F.size("shared") > 1) | F.exists("shared", lambda w: w["rare"]))
    return pairs.filter(alike & telling).select("a", "b").distinct()


class _Assigner:
    """The ordered pass over messages whose subjects may match: a component, or a whole tenant."""

    def __init__(self):
        self.groups: list[dict] = []
        self.known: dict[frozenset, tuple | None] = {}  # what a token set was found to match, since the last new signature
        self.posting: dict[str, set[frozenset]] = defaultdict(set)
        # of each distinct set: weights, mass, a heap of the (group, place within the group) that have it, and those that no longer do
        self.signatures: dict[frozenset, tuple] = {}
        self.version = 0  # of all that a message's outcome depends on

    def _changed(self) -> None:
        self.known.clear()
        self.version += 1

    def _first(self, key: frozenset) -> tuple | None:
        """The first (group, place) with this set: of equal sets, which score alike, no other is ever chosen."""
        _, _, heap, gone = self.signatures[key]
        while heap and heap[0] in gone:
            gone.discard(heapq.heappop(heap))
        return heap[0] if heap else None

    def _register(self, group: int, place: int, weights: dict) -> None:
        key = frozenset(weights)
        if key not in self.signatures:
            self.signatures[key] = (weights, sum(w[0] for w in weights.values()), [], set())
            for token in weights:
                self.posting[token].add(key)
        before = self._first(key)
        heapq.heappush(self.signatures[key][2], (group, place))
        if self._first(key) != before:
            self._changed()

    def _score(self, probe: dict, mass: float, other: dict, other_mass: float):
        shared = probe.keys() & other.keys()
        if not any(probe[t][2] for t in shared):
            return None
        both = sum(probe[t][0] for t in shared)
        cosine, containment = both / math.sqrt(mass * other_mass), both / min(mass, other_mass)
        if cosine < COSINE_ACCEPT and not (containment >= CONTAINMENT_ACCEPT and cosine >= COSINE_FLOOR):
            return None
        if len(shared) == 1 and not probe[next(iter(shared))][1]:
            return None
        return round(0.5 * cosine + 0.5 * containment, 4), sorted(shared, key=lambda t: (-probe[t][0], t))

    def _find(self, probe: dict):
        key = frozenset(probe)
        if key not in self.known:
            self.known[key] = self._best(probe)
        return self.known[key]

    def _best(self, probe: dict):
        mass = sum(w[0] for w in probe.values())
        near = set().union(*(self.posting.get(t, ()) for t in probe))
        best = None
        for key in near:
            if (first := self._first(key)) is None:
                continue
            (group, place), (weights, other_mass, _, _) = first, self.signatures[key]
            got = self._score(probe, mass, weights, other_mass)
            if got and (best is None or (-got[0], group, place) < best[0]):
                best = ((-got[0], group, place), group, got[0], got[1])
        return best and best[1:]

    def _add_variant(self, g: int, weights: dict) -> None:
        group = self.groups[g]
        key = frozenset(weights)
        if key != group["key"] and key not in group["variants"]:
            group["variants"].add(key)
            self._register(g, len(group["variants"]), weights)

    def _rename(self, g: int, weights: dict, display: str) -> None:
        """A richer phrase takes the group's name; the old one isn't kept as a variant."""
        group = self.groups[g]
        self.signatures[group["key"]][3].add((g, 0))
        group.update(key=frozenset(weights), weights=weights, display=display)
        self._register(g, 0, weights)
        self._changed()

    def __call__(self, row: dict) -> dict:
        probe = {w["token"]: (w["idf"], w["rare"], w["specific"]) for w in row["subject_w"]}
        found = self._find(probe)
        if found is None:
            g = len(self.groups)
            kind = "event" if row["item_type"] == "event" or row["act"] in ("new_event", "reschedule") else "task" if row["item_type"] == "task" else "subject"
            self.groups.append({"key": frozenset(probe), "weights": probe, "display": row["display"], "variants": set(), "kind": kind, "seed_seq": row["seq"]})
            self._register(g, 0, probe)
            score, tokens, seed = 1.0, sorted(probe), True
        else:
            (g, score, tokens), seed = found, False
            rich = lambda w: sum(x[2] for x in w.values())
            if rich(probe) > rich(self.groups[g]["weights"]):
                self._rename(g, probe, row["display"])
            self._add_variant(g, probe)
            if self.groups[g]["kind"] == "subject" and row["item_type"]:
                self.groups[g]["kind"] = row["item_type"]
                self._changed()
        if row["item_signature_w"]:
            self._add_variant(g, {w["token"]: (w["idf"], w["rare"], w["specific"]) for w in row["item_signature_w"]})
        group = self.groups[g]
        weak = (not seed and len(tokens) == 1) or row["subject_source"] == "open_question"
        return {"tenant": row["tenant"], "seq": row["seq"], "seed_seq": group["seed_seq"], "match_score": score, "match_tokens": tokens, "weak_link": weak, "seed": seed, "kind": group["kind"], "display": group["display"], "tokens": sorted(group["key"])}


_ASSIGNED = pa.schema([("tenant", pa.string()), ("seq", pa.int64()), ("seed_seq", pa.int64()), ("match_score", pa.float64()), ("match_tokens", pa.list_(pa.string())), ("weak_link", pa.bool_()), ("seed", pa.bool_()), ("kind", pa.string()), ("display", pa.string()), ("tokens", pa.list_(pa.string()))])


def _folded(made: Callable, keys: list[str], schema: pa.Schema) -> Callable:
    """For mapInArrow over rows sorted by ``keys``: a new ``made()`` for each key takes its rows one by one."""

    def run(batches):
        at, step = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (key := tuple(row[k] for k in keys)) != at:
                    at, step = key, made()
                out.append(step(row))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


#: what a message's outcome depends on besides the fold's state, after the keys of the fold; outcomes kept for it at most
_SAME = ["tenant", "component", "set_id", "item_set_id", "item_type", "act", "subject_source", "display"]
MOST_KNOWN = 100_000
#: messages whose outcomes stand that are passed in one step, at most
MOST_PASSED = 512


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple]]:
    """For each row the number of its ``_SAME``, and these by number."""
    code = np.zeros(len(batch), np.int64)
    for name in _SAME:
        one = batch.column(name).dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * len(one.dictionary) + one.indices.to_numpy(), return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return code, list(zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in _SAME)))


def _assigned(batches):
    """For mapInArrow over rows sorted by tenant, component and seq: ``_Assigner`` for each component.

    A message that starts no group and changes no outcome has the outcome of any other of the same
    ``_SAME`` until one changes, so only the first of these is folded, and only its
    weights become Python objects; runs of messages whose outcomes stand are passed at once.
    """
    at, step, known = None, None, {}
    for n, batch in enumerate(batches):
        code, keys = _coded(batch)
        out, place, i = [], np.empty(len(batch), np.int64), 0
        stands, slot = np.zeros(len(keys), bool), np.empty(len(keys), np.int64)
        while i < len(batch):
            if stands[code[i]]:
                run = stands[code[i : i + MOST_PASSED]]
                end = i + (len(run) if run.all() else int(run.argmin()))
                place[i:end] = slot[code[i:end]]
                i = end
                continue
            key = keys[code[i]]
            if key[:2] != at:
                at, step, known = key[:2], _Assigner(), {}
            found = known.get(key)
            if found is None or found[0] != step.version:
                before = step.version
                made = step(batch.slice(i, 1).to_pylist()[0])
                if step.version != before:
                    stands[:] = False
                if len(known) >= MOST_KNOWN:
                    known.clear()
                found = known[key] = [step.version if step.version == before and not made["seed"] else -1, made, -1, -1]
            if found[2] != n:
                found[2:] = n, len(out)
                out.append(found[1])
            place[i] = slot[code[i]] = found[3]
            stands[code[i]] = found[0] == step.version
            i += 1
        rows = pa.RecordBatch.from_pylist(out, _ASSIGNED).take(pa.array(place))
        yield rows.set_column(1, "seq", batch.column("seq"))


def matches_itself(weights: Column) -> Column:
    """Whether a token set matches an equal one: a lone token must be rare for that."""
    return F.exists(weights, lambda w: w["specific"]) & ((F.size(weights) > 1) | F.exists(weights, lambda w: w["rare"]))


def _lone(rows: DataFrame) -> DataFrame:
    """What ``_assigned`` gives for messages that match none, not even an equal one: each starts a group of its own, in any order."""
    event = F.coalesce((F.col("item_type") == "event") | F.col("act").isin("new_event", "reschedule"), F.lit(False))
    tokens = F.array_sort(F.transform("subject_w", lambda w: w["token"]))
    made = {
        "seed_seq": F.col("seq"), "match_score": F.lit(1.0), "match_tokens": tokens, "weak_link": F.coalesce(F.col("subject_source") == "open_question", F.lit(False)), "seed": F.lit(True),
        "kind": F.when(event, "event").when(F.col("item_type") == "task", "task").otherwise("subject"), "tokens": tokens,
    }
    return rows.withColumns(made).select("tenant", "seq", *made, "display")


def assign(rows: DataFrame, idf: DataFrame, keep: Callable = written) -> DataFrame:
    """Members: each row with a subject, its group and how it was matched. ``keep`` writes the tables between the steps.

    Messages of sets that nothing matches, not even an equal set, aren't folded.
    """
    on = rows.filter(F.col("subject").isNotNull())
    sets = keep(token_sets(on, idf), "token-sets")
    by_tokens = lambda c, id_: sets.select("tenant", F.col("tokens").alias(c), F.col("set_id").alias(id_), F.col("weights").alias(f"{c}_w"))
    slim = on.select("tenant", "seq", "item_type", "act", "subject_source", F.col("subject")["display"].alias("display"), F.col("subject")["tokens"].alias("subject"), F.col("item_signature")["tokens"].alias("item_signature"))
    slim = slim.join(by_tokens("subject", "set_id"), ["tenant", "subject"]).join(by_tokens("item_signature", "item_set_id"), ["tenant", "item_signature"], "left").drop("subject", "item_signature")
    named_together = slim.filter("item_set_id is not null").select(F.col("set_id").alias("a"), F.col("item_set_id").alias("b")).distinct()
    found = components(matching_sets(sets).unionAll(named_together))
    slim = slim.join(found.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
    alone = F.col("component").isNull() & ~matches_itself(F.col("subject_w"))
    folded = spread(slim.filter(~alone).withColumn("component", F.coalesce("component", "set_id")), "tenant", "component").sortWithinPartitions("tenant", "component", "seq")
    out = keep(folded.mapInArrow(_assigned, ASSIGNED).unionByName(_lone(slim.filter(alone))), "assigned")
    removed(found)
    numbers = numbered_in_order(out.filter("seed").select("tenant", "seed_seq"), ["tenant"], F.shiftright("seed_seq", 16), [F.col("seed_seq")], "group_no")
    out = out.join(numbers, ["tenant", "seed_seq"]).drop("seed_seq")
    out = out.withColumns({"group_id": F.format_string("GROUP_%03d", "group_no"), "title": T.group_title(F.col("display"), F.col("tokens"))}).drop("display", "tokens")
    return out.join(rows, ["tenant", "seq"])


# ---------------------------------------------------------------------------
_CHANGE = pa.struct([(n, pa.string()) for n in ("field", "previous", "new", "raw", "direction", "origin")] + [("flagged_conflict", pa.bool_())])
_TRANSITION = pa.struct([(n, pa.string()) for n in ("previous", "new", "act", "reason")])
_CONFLICT = pa.struct([("kind", pa.string()), ("message_ids", pa.list_(pa.string())), ("detail", pa.string())])
_TEXTS = ["status", "status_reason", "status_source", "latest_deadline", "latest_deadline_source", "pending_relative_deadline", "pending_relative_source", "latest_date", "latest_time", "schedule_source", "last_move", "last_move_source", "last_move_previous", "first_seen", "last_seen", "first_sender", "first_message"]
_COUNTS = ["chase_count", "restatement_count", "deadline_restatements", "n_moves", "n_members", "n_links", "n_weak", "n_items", "n_status", "n_conflicts"]
_FLAGS = ["response_required", "urgency_flagged", "de_escalated", "contested", "has_deadline_conflict", "has_chase_after_closure", "high_risk"]
_LISTS = ["unresolved_alternatives", "applied_acts", "roles"]
_STATE = pa.schema(
    [("tenant", pa.string()), ("group_no", pa.int64()), ("seq", pa.int64())]
    + [(n, pa.string()) for n in _TEXTS] + [(n, pa.int64()) for n in _COUNTS] + [("link_score", pa.float64())] + [(n, pa.bool_()) for n in _FLAGS] + [(n, pa.list_(pa.string())) for n in _LISTS]
    + [("transitions", pa.list_(_TRANSITION)), ("changes", pa.list_(_CHANGE)), ("conflicts", pa.list_(_CONFLICT))]
)
STATE = (
    "tenant string, group_no long, seq long, " + ", ".join(f"{n} string" for n in _TEXTS) + ", " + ", ".join(f"{n} long" for n in _COUNTS) + ", link_score double, "
    + ", ".join(f"{n} boolean" for n in _FLAGS) + ", " + ", ".join(f"{n} array<string>" for n in _LISTS)
    + ", transitions array<struct<previous:string,new:string,act:string,reason:string>>, changes array<struct<field:string,previous:string,new:string,raw:string,direction:string,origin:string,flagged_conflict:boolean>>"
    + ", conflicts array<struct<kind:string,message_ids:array<string>,detail:string>>"
)


def _moved(previous: str | None, new: str) -> str:
    return "set" if previous is None else "earlier" if new < previous else "later" if new > previous else "unchanged"


class _Lifecycle:
    """State of one group; ``step`` applies a message and returns the state after it."""

    def __init__(self):
        self.s: dict = dict.fromkeys(_TEXTS) | dict.fromkeys(_COUNTS, 0) | dict.fromkeys(_FLAGS, False) | {n: [] for n in _LISTS} | {"link_score": 0.0}
        self.s.update(status="unclear", status_reason="nothing certain was said so far")
        self.branches = {
            "new_task": self._raised, "new_event": self._raised, "progress_update": self._progress, "completion": self._closed,
            "cancellation": self._closed, "reschedule": self._rescheduled, "deadline_change": self._deadline_changed,
        }

    @property
    def terminal(self) -> bool:
        return self.s["status"] in S.TERMINAL

    def _conflict(self, kind: str, ids: list, detail: str, contests: bool = False) -> None:
        self.out["conflicts"].append({"kind": kind, "message_ids": ids, "detail": detail})
        self.s["n_conflicts"] += 1
        self.s["contested"] |= contests
        self.s["has_deadline_conflict"] |= kind == "deadline_changed"
        self.s["has_chase_after_closure"] |= kind == "chased_after_closure"

    def _move_to(self, m: dict, status: str, reason: str) -> None:
        if self.s["n_status"] and self.s["status"] == status:
            return
        self.out["transitions"].append({"previous": self.s["status"], "new": status, "act": m["act"], "reason": reason})
        self.s.update(status=status, status_reason=reason, status_source=m["message_id"], n_status=self.s["n_status"] + 1)

    def _member(self, m: dict) -> None:
        s = self.s
        s["n_members"] += 1
        if not m["seed"]:
            s["n_links"] += 1
            s["link_score"] += m["match_score"]
        s["n_weak"] += m["weak_link"]
        s["n_items"] += m["item_type"] is not None
        if s["first_seen"] in (None, ""):
            s["first_seen"] = m["timestamp"]
        if s["n_members"] == 1:
            s.update(first_sender=m["sender"], first_message=m["message_id"])
        s["last_seen"] = m["timestamp"]
        s["high_risk"] |= m["overall_risk"] == "high"
        if (m["sender"] or "").strip().lower() in S.AUTHORITY_SENDERS and m["sender"] not in s["roles"]:
            s["roles"] = sorted([*s["roles"], m["sender"]])

    def _seed(self, m: dict) -> None:
        """What the first extraction said stands until an act says otherwise."""
        s = self.s
        if m["act"] in ("new_task", "new_event", "deadline_change", "reschedule"):
            return
        if not (m["seed"] or (s["latest_deadline"] is None and s["latest_date"] is None)):
            return
        if m["item_type"] == "task" and m["item_date"] and not s["latest_deadline"]:
            s.update(latest_deadline=m["item_date"], latest_deadline_source=m["message_id"])
        if m["item_type"] == "event":
            if m["item_date"] and not s["latest_date"]:
                s.update(latest_date=m["item_date"], schedule_source=m["message_id"])
            if m["item_time"] and not s["latest_time"]:
                s["latest_time"] = m["item_time"]

    def _set_deadline(self, m: dict) -> None:
        s, first = self.s, m["act_frame"] == "l1_extraction"
        new = m["new_date"] or (m["item_date"] if m["act"] == "new_task" else None)
        change = {"field": "deadline", "previous": s["latest_deadline"], "flagged_conflict": m["conflict_marker"]}
        if new:
            direction = _moved(s["latest_deadline"], new)
            self.out["changes"].append(change | {"new": new, "direction": direction, "origin": "l1_request" if first else "l2_update"})
            if direction in ("earlier", "later"):
                if first:
                    s["deadline_restatements"] += 1
                else:
                    s.update(n_moves=s["n_moves"] + 1, last_move=direction, last_move_source=m["message_id"], last_move_previous=s["latest_deadline"])
                    flagged = "; its sender says that another date was given before" if m["conflict_marker"] else ""
                    self._conflict("deadline_changed", [m["message_id"]], f"due {new} instead of {s['latest_deadline']}, {direction}{flagged}")
            s.update(latest_deadline=new, latest_deadline_source=m["message_id"], pending_relative_deadline=None, pending_relative_source=None)
        elif m["new_date_raw"]:
            raw = m["new_date_raw"] + (f" at {m['new_time']}" if m["new_time"] else "")
            s.update(pending_relative_deadline=raw, pending_relative_source=m["message_id"])
            self.out["changes"].append(change | {"raw": raw, "direction": "unresolved", "origin": "l2_update"})

    def _raised(self, m: dict) -> None:
        if not self.s["n_status"]:
            self._move_to(m, "pending", "it came up as new")
        self._set_deadline(m)

    def _progress(self, m: dict) -> None:
        if not self.terminal:
            self._move_to(m, "in_progress", "somebody says it is under way")

    def _closed(self, m: dict) -> None:
        done = m["act"] == "completion"
        to, other = ("completed", "cancelled") if done else ("cancelled", "completed")
        if self.s["status"] == other:
            detail = "called done when it was cancelled already" if done else "called off when it was done already"
            self._conflict(f"{to}_after_{other}", [self.s["status_source"] or "", m["message_id"]], detail, contests=True)
        self._move_to(m, to, "somebody says it is done" if done else "somebody calls it off")
        self.s["response_required"] = False

    def _rescheduled(self, m: dict) -> None:
        s = self.s
        if self.terminal:
            self._conflict("rescheduled_after_closure", [m["message_id"], s["status_source"] or ""], f"a new slot was set when it was {s['status']} already", contests=True)
        else:
            self._move_to(m, "rescheduled", "somebody gives it a new slot")
        for field, new in (("date", m["new_date"]), ("time", m["new_time"])):
            if new:
                before = s[f"latest_{field}"]
                direction = _moved(before, new) if field == "date" else "unchanged" if before == new else "set"
                self.out["changes"].append({"field": field, "previous": before, "new": new, "direction": direction, "flagged_conflict": False})
                s.update({f"latest_{field}": new, "schedule_source": m["message_id"]})

    def _deadline_changed(self, m: dict) -> None:
        if self.terminal:
            self._conflict("deadline_changed_after_closure", [m["message_id"], self.s["status_source"] or ""], f"a new deadline was set when it was {self.s['status']} already", contests=True)
        elif not self.s["n_status"]:
            self._move_to(m, "pending", "it has a deadline and is not said to be done")
        self._set_deadline(m)

    def _chased(self, m: dict) -> None:
        self.s["chase_count"] += 1
        self.s["response_required"] = True
        if self.terminal:
            self._conflict("chased_after_closure", [m["message_id"], self.s["status_source"] or ""], f"somebody still asks for it though it is {self.s['status']}", contests=True)

    def _hedged(self, m: dict) -> None:
        s = self.s
        if self.terminal or s["n_status"]:
            self._conflict("hedged_contradiction" if self.terminal else "hedged_note", [m["message_id"]], "a later message is unsure about it; the status stays")
        else:
            s.update(status_reason="all that was said about it is unsure", status_source=m["message_id"])

    def _act(self, m: dict) -> None:
        s, act = self.s, m["act"]
        s["urgency_flagged"] |= m["urgent"]
        s["de_escalated"] |= m["de_escalated"]
        if m["alternatives"]:
            s["unresolved_alternatives"] = list(dict.fromkeys([*s["unresolved_alternatives"], *m["alternatives"]]))
            self._conflict("unresolved_alternatives", [m["message_id"]], f"left open: {' or '.join(m['alternatives'])}")
        if act in S.CHASE_ACTS:
            self._chased(m)
        elif act == "ambiguous_update":
            self._hedged(m)
        elif m["repetition"] and act in s["applied_acts"]:
            s["restatement_count"] += 1
        elif act in self.branches:
            if act not in s["applied_acts"]:
                s["applied_acts"] = [*s["applied_acts"], act]
            self.branches[act](m)

    def step(self, m: dict) -> dict:
        self.out: dict = {"transitions": [], "changes": [], "conflicts": []}
        self._member(m)
        self._seed(m)
        self._act(m)
        return {"tenant": m["tenant"], "group_no": m["group_no"], "seq": m["seq"], **self.s, **self.out}


def lifecycle(members: DataFrame) -> DataFrame:
    """The state of its group after each member, with what the member changed."""
    wanted = members.select(
        "tenant", "group_no", "seq", "message_id", "timestamp", "sender", "act", "act_frame", "urgent", "de_escalated", "alternatives", "repetition", "conflict_marker", "new_date", "new_date_raw", "new_time",
        "item_type", "item_date", "item_time", "seed", "match_score", "weak_link", "overall_risk",
    )
    rows = wanted.repartition("tenant", "group_no").sortWithinPartitions("tenant", "group_no", "seq")
    return rows.mapInArrow(_folded(lambda: _Lifecycle().step, ["tenant", "group_no"], _STATE), STATE)


def group_confidence() -> Column:
    """Trust that a group is one subject with this status, from its state."""
    cohesion = F.when(F.col("n_links") > 0, F.col("link_score") / F.col("n_links")).otherwise(0.86) - 0.06 * F.least("n_weak", F.lit(3))
    status = F.when(F.col("n_status") > 0, 0.90).when(F.col("n_items") > 0, 0.78).otherwise(0.55)
    status = status - F.when(F.col("contested"), 0.22).otherwise(0.0) - F.when(F.size("unresolved_alternatives") > 0, 0.10).otherwise(0.0) - 0.04 * F.least("n_conflicts", F.lit(3))
    return F.round(F.greatest(F.lit(0.30), F.least(0.5 * cohesion + 0.5 * status + 0.08, F.lit(0.97))), 4)


def summary_of() -> Column:
    """A sentence made only of what is on record."""
    c, s = F.col, lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    n = lambda name: c(name).cast("string")
    day = F.left("first_seen", F.lit(10))
    at = F.coalesce(s(" (from ", c("latest_deadline_source"), ")"), F.lit(""))
    parts = [
        F.when(F.coalesce(day, F.lit("")) != "", s("First from ", c("first_sender"), " on ", day)).otherwise(s("First from ", c("first_sender"))),
        F.when(c("n_moves") > 0, s("due ", c("latest_deadline"), " after ", n("n_moves"), " change(s)", at)).when(c("latest_deadline").isNotNull(), s("due ", c("latest_deadline"), at)),
        F.when(c("pending_relative_deadline").isNotNull(), s('last due "', c("pending_relative_deadline"), '" by ', c("pending_relative_source"), ", which names no date")),
        F.when(c("latest_date").isNotNull() | c("latest_time").isNotNull(), s("set for ", F.concat_ws(" at ", "latest_date", "latest_time"), F.coalesce(s(" (from ", c("schedule_source"), ")"), F.lit("")))),
        F.when(c("deadline_restatements") > 0, s(n("deadline_restatements"), " request(s) gave it another date")),
        F.when(c("chase_count") > 0, s("asked after ", n("chase_count"), " time(s)")),
        F.when(c("restatement_count") > 0, s(n("restatement_count"), " message(s) said again")),
        F.when(c("status") == "completed", s("done by ", c("status_source"))).when(c("status") == "cancelled", s("called off by ", c("status_source"))).when(c("status") == "rescheduled", F.lit("in a new slot")).when(c("status") == "unclear", F.lit("nothing certain was said of its state")),
        F.when(c("contested"), F.lit("its messages disagree")),
        F.when(F.size("unresolved_alternatives") > 0, s("left open: ", F.array_join("unresolved_alternatives", " or "))),
    ]
    return F.concat(F.concat_ws("; ", *parts), F.lit("."))


def final_groups(members: DataFrame, states: DataFrame) -> DataFrame:
    """One row per group: its last state, finalised, with title, kind, members and items."""
    ends = members.groupBy("tenant", "group_no").agg(F.max("seq").alias("seq"))
    last = states.drop("transitions", "changes", "conflicts").join(ends, ["tenant", "group_no", "seq"]).drop("seq")
    by_seq = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c])
    made = members.groupBy("tenant", "group_no").agg(F.first("group_id").alias("group_id"), F.max_by("title", "seq").alias("title"), F.max_by("kind", "seq").alias("kind"), by_seq("message_id").alias("message_ids"), by_seq("item_id").alias("item_ids"))
    out = last.join(made, ["tenant", "group_no"])
    implied = (F.col("status") == "unclear") & (F.col("n_status") == 0) & (F.col("n_items") > 0)
    out = out.withColumns(
        {
            "status_reason": F.when(implied, "it was asked for, and nothing that came later ends or moves it").otherwise(F.col("status_reason")),
            "status_source": F.when(implied, F.col("first_message")).otherwise(F.col("status_source")),
            "status": F.when(implied, "pending").otherwise(F.col("status")),
        }
    )
    return out.withColumns({"confidence": group_confidence(), "summary": summary_of()})


def histories(members: DataFrame, states: DataFrame) -> dict[str, DataFrame]:
    """status_history, deadline_history, schedule_history and conflicts, one row per entry in order."""
    about = states.join(members.select("tenant", "seq", "group_id", "message_id", "timestamp", "batch_idx"), ["tenant", "seq"])
    keys = ["tenant", "group_id", "seq", "batch_idx", "message_id", "timestamp"]
    changes = about.select(*keys, F.posexplode("changes").alias("ord", "c")).select(*keys, "ord", "c.*")
    return {
        "status_history": about.select(*keys, F.posexplode("transitions").alias("ord", "t")).select(*keys, "ord", "t.*"),
        "deadline_history": changes.filter("field = 'deadline'"),
        "schedule_history": changes.filter("field <> 'deadline'"),
        "conflicts": about.select(*keys, F.posexplode("conflicts").alias("ord", "c")).select(*keys, "ord", "c.*"),
    }
