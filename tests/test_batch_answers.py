"""Answers to a table of questions against a plain evaluation of each question, row by row."""

import random
import re

import pytest

from plotweave.operators import batch_answers as B
from plotweave.operators.answers import Narrative

PEOPLE = [("c1", "character", "Ann Field"), ("c2", "character", "Bob Stone"), ("c3", "character", "Cy Marsh"), ("c4", "character", "Dee Wood"), ("o1", "organization", "The Mill"), ("l1", "location", "Harbour Bar")]
WEIGHTS = {"family": 100, "associated_with": 95, "works_with": 90, "advisor_to": 85, "co_present_dialogue": 50}


def story():
    rng = random.Random(3)
    ids = [p[0] for p in PEOPLE]
    edges = [(f"kg_{k:03d}", rng.choice(ids), rng.choice([*WEIGHTS, "owns"]), rng.choice([*ids, "gone"]), "stable", [f"scene:s{rng.randint(1, 9)}"] * rng.randint(0, 2)) for k in range(30)]
    scenes = [(f"s{k}", k, f"INT. ROOM {k} - NIGHT" if k % 4 else "", "ROOM", 1970 + k % 3 if k % 2 else None, None if k % 2 else 1980) for k in range(1, 13)]
    words = ["talks", "leaves", "the", "bar", "Ann", "gun", "night", "of", "shot", "quietly"]
    events = []
    for k in range(70):
        who = [(x, "speaker") for x in rng.sample(ids, rng.randint(0, 3))]
        events.append((f"evt_{k:03d}", f"s{rng.randint(1, 13)}", rng.choice(["talk", "act"]), rng.choice(["question", "shooting", "exit"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), who, ["a snippet of " + rng.choice(words)] * rng.randint(0, 2), [f"ref_{k % 40}"] * rng.randint(0, 2), rng.randint(1, 6), 0.5))
    changes = []
    for k in range(40):
        a, b = rng.choice(ids), rng.choice(ids)
        changes.append((f"sc_{k:03d}", a, b, rng.choice(["trust", "fear"]), rng.choice(["increase", "decrease"]), rng.choice(["explicit", "inferred"]), rng.choice(["low", None, "high"]), round(rng.random(), 2), f"s{rng.randint(1, 12)}", [f"evt_{rng.randint(0, 75):03d}" for _ in range(rng.randint(0, 4))], [f"ref_{rng.randint(0, 50)}" for _ in range(rng.randint(0, 2))], [f"rule_{k % 5}"]))
    changes = [(*c[:9], list(dict.fromkeys(c[9])), *c[10:]) for c in changes]
    blocks = [(f"blk_{k:03d}", f"s{rng.randint(1, 12)}", rng.choice(["utterance", "action"]), k, rng.choice(["ANN FIELD", "BOB", None]), " ".join(rng.choice([*words, "Bob Stone"]) for _ in range(rng.randint(1, 30)))) for k in range(50)]
    return edges, scenes, events, changes, blocks


def asked():
    names = [p[2] for p in PEOPLE]
    shapes = ["Who is {a} connected to?", "How does {a}'s relationship with {b} change over time?", "When does {a} leave in 1970?", "Timeline of {a} and {b}", "Compare {a} with {b}", "Why did {a} do it because of the night?", "Show proof for {a}", "the bar", "talks", "gun"]
    rng = random.Random(8)
    rows = []
    for k in range(70):
        rows.append((f"q{k:03d}", rng.choice(shapes).format(a=rng.choice(names), b=rng.choice(names)), rng.choice(["auto", "auto", None, "ntg", "kg", "hybrid", "baseline"]), rng.choice([True, None, False]), rng.choice([True, None, False])))
    rows += [("z1", None, "auto", True, True), ("z2", "", "ntg", True, None), ("z3", "timeline", None, None, None), ("z4", "what happens first in 1980", None, None, None), ("z5", "state change", "auto", False, True), ("z6", "mill", "kg", True, None), ("z7", "shot", "ntg", True, True), ("z8", "relationship between Bob Stone and Bob Stone", None, None, None)]
    return rows


def cut(s, most):
    return s if len(s) <= most else s[: most - 3].rstrip() + "..."


def shown(names):
    return "no matched entities" if not names else ", ".join(names[:4]) + (f" (+{len(names) - 4} more)" if len(names) > 4 else "")


class Plain:
    """One question at a time over lists."""

    def __init__(self):
        self.edges, self.scenes, self.events, self.changes, self.blocks = story()
        self.name = {p[0]: p for p in PEOPLE}
        self.scene = {s[0]: s for s in self.scenes}
        self.event = {e[0]: e for e in self.events}

    def year(self, scene):
        s = self.scene.get(scene)
        return None if s is None else s[4] if s[4] is not None else s[5]

    def people(self, e):
        return [p[0] for p in e[5]]

    def graph(self, q):
        if q["ids"]:
            me, rows = q["ids"][0], []
            for e in self.edges:
                if e[1] == me:
                    rows.append(("out", e, e[3]))
                elif e[3] == me:
                    rows.append(("in", e, e[1]))
            label = lambda other, e: self.name[other][2] if other in self.name else e[0]
            rows.sort(key=lambda r: (-WEIGHTS.get(r[1][2], 60), label(r[2], r[1]), r[1][0]))
            top = rows[:8]
            characters = [r for r in top if r[2] in self.name and self.name[r[2]][1] == "character"]
            top = characters[:6] if len(characters) >= 3 else top
            lines = [f"KG view of {self.name[me][2]}: {len(top)} high-signal relationship(s) from the local graph artifact."]
            for k, (way, e, other) in enumerate(top, 1):
                who = f"{self.name[other][2]} ({self.name[other][1]})" if other in self.name else e[3]
                lines.append(f"{k}. [{way}] {e[2]} -> {who} [{e[4]}]" + (f", evidence refs: {len(e[5])}" if e[5] else ""))
            if len(rows) > len(top):
                lines.append(f"Additional relationships omitted for brevity: {len(rows) - len(top)}.")
            return "\n".join(lines), min(0.95, 0.55 + len(top) * 0.05), [me, *(r[2] for r in top if r[2] in self.name)], [], [], [x for r in top for x in r[1][5]], B.KG_NOTES
        text = q["question"].strip().lower()
        found = sorted((p for p in PEOPLE if text in p[2].lower() or text in p[0] or text in p[2].upper().lower()), key=lambda p: (p[1], p[2], p[0]))[:5]
        if found:
            lines = ["KG entity search candidates for this question (no direct focus entity detected):", *(f"{k}. {p[2]} ({p[1]}) [{p[0]}]" for k, p in enumerate(found, 1)), 'Ask with a specific entity name (for example "Frank Sheeran" or "Jimmy Hoffa") for relationship neighbors.']
        else:
            lines = ["No direct entity match detected for this fact-style query.", "Try including a specific person or organization name to retrieve KG relationships."]
        return "\n".join(cut(x, 220) for x in lines), 0.42 if found else 0.2, [p[0] for p in found], [], [], [], B.KG_SEARCH_NOTES

    def trace(self, q):
        ids, kind = q["ids"], q["query_type"]
        pair = sorted(ids[:2]) if len(ids) >= 2 else None
        me = ids[0] if ids else None
        m = re.search(r"\b(19\d{2}|20\d{2})\b", q["question"])
        year = int(m[1]) if m else None
        of_pair = lambda c: c[1] != c[2] and sorted((c[1], c[2])) == pair
        if kind == "state_change":
            rows = sorted(c for c in self.changes if (of_pair(c) if pair else me is None or me in c[1:3]))
            top = rows[:8]
            if not top:
                return B.NO_CHANGE_TEXT, 0.25, ids, [], [], [], B.NO_CHANGE_NOTES
            lines = [f"NTG state-change view ({len(top)} of {len(rows)} matching changes) for {shown(q['names'])}."]
            led = [[self.event[x] for x in c[9] if x in self.event] for c in top]
            for c, events in zip(top, led, strict=True):
                trigger = "; ".join(f"{e[3]} ({e[1]}/{e[8]})" for e in events[:2])
                lines.append(f"- {self.name[c[1]][2]} -> {self.name[c[2]][2]}: {c[3]} {c[4]}{f' ({c[6]})' if c[6] else ''} [{c[5]}] in {self.scene[c[8]][2]} (conf {c[7]:.2f}).{f' Triggers: {trigger}.' if trigger else ''}")
            if len(rows) > len(top):
                lines.append(f"Additional matching state changes omitted: {len(rows) - len(top)}.")
            return "\n".join(cut(x, 320) for x in lines), min(0.92, 0.58 + len(top) * 0.04), ids + [x for c in top for x in c[1:3]], [e[0] for events in led for e in events], [c[0] for c in top], [x for c in top for x in c[10]], B.CHANGE_NOTES
        words = None if kind == "timeline" else q["question"].strip().lower() or None
        fits = lambda e: (me is None or me in self.people(e)) and (pair is None or pair[0] != pair[1] and set(pair) <= set(self.people(e)))
        has = lambda e: words is None or any(words in x.lower() for x in (e[0], e[2], e[3], e[4], *e[6]))
        at = lambda e: (self.scene[e[1]][1] if e[1] in self.scene else 10**10, e[8], e[0])
        rows = sorted((e for e in self.events if fits(e) and has(e) and (year is None or self.year(e[1]) == year)), key=at)[: 14 if kind == "evidence" else 40]
        led = lambda e: [c[0] for c in self.changes if e[0] in c[9]]
        top = rows[: 10 if kind == "causal_chain" else 8]
        lists = (ids + [p for e in top for p in self.people(e)], [e[0] for e in top], [c for e in top for c in led(e)], [x for e in top for x in e[7]])
        if kind == "evidence":
            lines = [f"Evidence-centric NTG response ({len(top)} event(s)) for {shown(q['names'])}."]
            lines += [f"{k}. {e[0]} {e[3]} in {self.scene[e[1]][2] if e[1] in self.scene else e[1]} [refs: {len(e[7])}] {cut((e[6] or [''])[0] or e[4], 180)}" for k, e in enumerate(top, 1)]
            return "\n".join(lines), min(0.86, 0.45 + len(top) * 0.04) if top else 0.2, *lists, B.EVIDENCE_NOTES
        scenes = []
        for s in self.scenes:
            if year is not None and self.year(s[0]) != year:
                continue
            inside = [e for e in self.events if e[1] == s[0]]
            n = sum(fits(e) for e in inside)
            c = sum((me is None or me in x[1:3]) and (pair is None or of_pair(x)) for x in self.changes if x[8] == s[0])
            if (me or pair) and not n and not c:
                continue
            scenes.append((s, inside, n, c))
        scenes = scenes[:6]
        if not top and not scenes:
            return B.NO_EVENT_TEXT, 0.22, ids, [], [], [], B.NO_EVENT_NOTES
        lines = [("Heuristic event chain (NTG) for " if kind == "causal_chain" else "Scene-ordered NTG timeline slice for ") + f"{shown(q['names'])}:"]
        for k, (s, inside, n, c) in enumerate(scenes, 1):
            tag = f" matched events={n}, state changes={c}" if n or c else ""
            y = self.year(s[0])
            lines.append(f"{k}. {s[0]} [{'-' if y is None else y}] {cut(s[2] or s[0], 140)}{tag}")
            for e in sorted(inside, key=lambda e: (e[8], e[0]))[:3]:
                over = len(led(e)) if e in rows else 0
                lines.append(f"   - {e[0]} {e[3]} (#{e[8]}{f', state overlays={over}' if over else ''}): {cut(e[4], 160)}")
        if kind == "causal_chain":
            lines.append(B.CHAIN_TEXT)
        return "\n".join(cut(x, 360) for x in lines), min(0.88, 0.5 + min(len(top), 10) * 0.03), *lists, B.TIMELINE_NOTES if kind == "timeline" else B.CHAIN_NOTES

    def retrieval(self, q):
        ids = set(q["ids"])
        words = lambda t: [w for w in re.sub(r"[^a-z0-9\s']", " ", t.lower()).split() if len(w) >= 2]
        own, whole = set(words(q["question"])), q["question"].strip().lower()
        score = lambda t: 0 if not own or not words(t) else sum(w in own for w in words(t)) + 2 * (whole in t.lower())
        docs = []
        for e in self.events:
            if not ids or ids & set(self.people(e)):
                said = f"{e[4]}\n{(e[6] or [''])[0]}".strip()
                docs.append(("event", e[0], e[1], said, e[7], score(f"{e[3]} {said}")))
        for c in self.changes:
            if not ids or ids & set(c[1:3]):
                docs.append(("state_change", c[0], c[8], f"{c[3]} {c[4]} {c[5]} {c[1]} {c[2]}", c[10], score(f"{c[3]} {c[4]} {c[5]} {' '.join(c[11])}")))
        for b in self.blocks:
            if not ids or any(n.lower() in f"{b[4] or ''} {b[5]}".lower() for n in q["names"]):
                docs.append(("script_block", b[0], b[1], f"{b[4] + ': ' if b[4] else ''}{b[5]}", [], score(f"{b[2]} {b[5]}")))
        top = sorted((d for d in docs if d[5] > 0), key=lambda d: (-d[5], d[2], d[1]))[:6]
        if not top:
            return B.NO_MATCH_TEXT, 0.12, q["ids"], [], [], [], B.BASELINE_NOTES
        lines = [f"Baseline retrieval returned {len(top)} top text chunk(s) for {shown(q['names'])}.", *(f"{k}. [{d[0]} ({d[2]})] {cut(d[3], 220)}" for k, d in enumerate(top, 1)), B.BASELINE_TEXT]
        return "\n".join(lines), min(0.78, 0.28 + top[0][5] / 12), q["ids"], [d[1] for d in top if d[0] == "event"], [d[1] for d in top if d[0] == "state_change"], [x for d in top for x in d[4]], B.BASELINE_NOTES

    def finish(self, a, refs, reason):
        text, sure, ents, events, changes, evidence, notes = a
        once = lambda v: list(dict.fromkeys(x.strip() for x in v if x.strip()))
        evidence = once(evidence) if refs else []
        notes = notes if refs else f"{notes} {B.OMITTED}"
        notes = notes if reason in notes else f"{notes} {reason}"
        if not evidence and (events or changes):
            notes = f"{notes} {B.NO_REFS}"
        return text.strip(), round(sure, 9), once(ents), once(events), once(changes), evidence, notes

    def answer(self, q, row):
        wanted, refs, kind = (row[2] or "auto"), row[3] is not False, q["query_type"]
        reason = (B.FACT_WITH if q["ids"] else B.FACT_WITHOUT) if kind == "fact" else B.ROUTES[kind]
        reason = reason if wanted == "auto" else f"User preferred {wanted} mode override."
        mode = q["mode_used"]
        if mode == "kg":
            main = self.graph(q)
        elif mode == "ntg":
            main = self.trace(q)
        elif mode == "baseline_rag":
            main = self.retrieval(q)
        else:
            k, t = self.graph(q), self.trace(q)
            omitted = "" if refs else f" {B.OMITTED}"
            if kind == "comparison":
                text = "\n".join(["Hybrid comparison answer:", "KG view (entity/relationship structure):", k[0], "", "NTG view (timeline/state-change structure):", t[0], "", "Use the baseline comparator for a lexical-only contrast if requested."])
            else:
                text = "\n".join(["Hybrid answer (KG + NTG):", f"- KG contribution: {k[6]}{omitted}", f"- NTG contribution: {t[6]}{omitted}", "", "KG summary:", k[0], "", "NTG summary:", t[0]])
            main = (text, min(0.93, max(k[1], t[1]) * 0.97 + 0.03), *(k[i] + t[i] for i in range(2, 6)), B.HYBRID_NOTES)
        beside = None
        if mode != "baseline_rag" and (row[4] or kind == "comparison"):
            beside = self.finish(self.retrieval(q), refs, B.BASELINE_ROUTE)
        return self.finish(main, refs, reason), beside


@pytest.fixture(scope="module")
def narrative(spark):
    edges, scenes, events, changes, blocks = story()
    person = "array<struct<entity_id:string,role:string>>"
    make = spark.createDataFrame
    return Narrative(
        make([(*p, [p[2].upper()]) for p in PEOPLE], "entity_id string, entity_type string, canonical_name string, aliases array<string>"),
        make([("o1", "mill", "MILL", "manual_alias")], "entity_id string, alias_raw string, alias_normalized string, source string"),
        make(edges, "edge_id string, subject_id string, predicate string, object_id string, stability string, evidence_refs array<string>"),
        make(events, f"event_id string, scene_id string, event_type_l1 string, event_type_l2 string, summary string, participants {person}, snippets array<string>, evidence_refs array<string>, sequence_in_scene int, confidence double"),
        make(scenes, "scene_id string, scene_index int, header_raw string, location_raw string, year_explicit int, year_inferred int"),
        make(changes, "state_change_id string, subject_id string, object_id string, state_dimension string, direction string, claim_type string, magnitude string, confidence double, scene_id string, trigger_event_ids array<string>, evidence_refs array<string>, rule_ids array<string>"),
        make([], "from_event string, to_event string, relation string"),
        make(blocks, "block_id string, scene_id string, block_type string, sequence_in_scene int, speaker_cue_raw string, text string"),
    )


def test_every_question_gets_the_plain_answer(spark, narrative):
    rows = asked()
    questions = spark.createDataFrame(rows, "question_id string, question string, preferred_mode string, include_evidence boolean, include_baseline boolean")
    context = {r["question_id"]: r.asDict() for r in B.contexts(questions, narrative).collect()}
    flat = lambda a: (a["answer_text"], round(a["confidence"], 9), a["entities_used"], a["events_used"], a["state_changes_used"], a["evidence_refs"], a["reasoning_notes"])
    got = {r["question_id"]: (flat(r), r["baseline"] and flat(r["baseline"])) for r in B.answers(questions, narrative).collect()}
    plain = Plain()
    assert len({c["mode_used"] for c in context.values()}) == 4 and len({c["query_type"] for c in context.values()}) == 6
    assert len(got) == len(rows)
    for row in rows:
        assert got[row[0]] == plain.answer(context[row[0]], row), row


def test_entities_of_questions(spark, narrative):
    questions = spark.createDataFrame([("a", "Does the mill owe ann field 5 in 1975?", None), ("b", "Ann Fielding?", None), ("c", "stone and Marsh", None)], "question_id string, question string, preferred_mode string")
    got = {r["question_id"]: (r["ids"], r["pair"], r["year"]) for r in B.contexts(questions, narrative).collect()}
    assert got == {"a": (["o1", "c1"], "c1::o1", 1975), "b": ([], None, None), "c": (["c2", "c3"], "c2::c3", None)}


def test_no_questions(spark, narrative):
    none = spark.createDataFrame([], "question_id string, question string, preferred_mode string, include_evidence boolean, include_baseline boolean")
    assert B.answers(none, narrative).count() == 0


def test_kinds_that_no_question_asks_for_read_nothing(spark, narrative):
    kinds = "question_id string, question string, preferred_mode string, include_evidence boolean, include_baseline boolean"
    only = lambda *used: Narrative(*(getattr(narrative, t) if t in used else None for t in ("entities", "aliases", "edges", "events", "scenes", "changes", "temporal", "blocks")))
    asked_of = lambda question, n: [r["mode_used"] for r in B.answers(spark.createDataFrame([("q", question, "auto", True, False)], kinds), n).collect()]
    assert asked_of("Who is Ann Field connected to?", only("entities", "aliases", "edges")) == ["kg"]
    assert asked_of("How does Ann Field's relationship with Bob Stone change over time?", only("entities", "aliases", "events", "scenes", "changes")) == ["ntg"]


def test_places_alone_tell_which_events_are_listed(spark, narrative, monkeypatch):
    """Before an event's text is met, at most 40 events of each filter are left."""
    written = {}
    monkeypatch.setattr(B, "staged", lambda df, name: written.setdefault(name, df.cache()))
    questions = spark.createDataFrame([("q", "When does Ann Field leave?", "auto", True, False)], "question_id string, question string, preferred_mode string, include_evidence boolean, include_baseline boolean")
    assert B.answers(questions, narrative).count() == 1
    assert "filtered-events" not in written and written["first-events"].columns == ["trace_key", "at", "event_id"]


def test_retrieval_answers_write_and_shuffle_no_texts(spark, narrative, monkeypatch):
    """Only each question's best pieces are written, and pieces meet them where they are."""
    from plotweave.operators import retrieval

    written = {}
    for module in (B, retrieval):
        monkeypatch.setattr(module, "staged", lambda df, name, staged=module.staged: written.setdefault(name, staged(df, name)))
    questions = spark.createDataFrame([("q1", "the bar", "baseline", True, False), ("q2", "Compare Ann Field with Bob Stone at night", "auto", True, False)], "question_id string, question string, preferred_mode string, include_evidence boolean, include_baseline boolean")
    contexts = B.contexts(questions, narrative)
    written.clear()
    got = B.retrieval_answers(contexts, narrative)
    assert {*written} == {"kinds", "asked-words", "best-pieces"} and written["best-pieces"].count() == 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "scored_text" not in plan
    assert {r["question_id"]: r["answer_text"][:36] for r in got.collect()} == dict.fromkeys(["q1", "q2"], "Baseline retrieval returned 6 top te")
