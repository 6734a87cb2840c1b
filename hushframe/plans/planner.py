"""Audit, rule planner, reply validation and replay of the step loop as column expressions over request and step tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.patterns import SENSITIVE_GOAL, jvm
from hushframe.functions.scan import audit_kinds
from hushframe.operators.extract import goal_words

ELEMENTS = "array<struct<i:int,tag:string,type:string,role:string,label:string,sensitive:string,filled:boolean>>"
HISTORY = "array<struct<type:string,index:int>>"
ACTION = "struct<type:string,index:int,text:string,dy:int>"
STEPS, STALL = 8, 1


def leak_audit(text: Column, title: Column, elements: Column) -> Column:
    """Sorted distinct kinds found in the record's text, title and labels."""
    labels = F.transform(elements, lambda e: F.coalesce(e["label"], F.lit("")))
    return audit_kinds(F.array_join(F.concat(F.array(F.coalesce(text, F.lit("")), F.coalesce(title, F.lit(""))), labels), " "))


def _action(type_: str, index: Column | None = None, text: Column | None = None, dy: int | None = None) -> Column:
    return F.struct(F.lit(type_).alias("type"), (F.lit(None) if index is None else index).cast("int").alias("index"), (F.lit(None) if text is None else text).cast("string").alias("text"), F.lit(dy).cast("int").alias("dy"))


def choose_action(goal: Column, text: Column, elements: Column, history: Column) -> Column:
    """struct<action, reason>: summarise, scroll, fill or refuse, click the label that shares most words with the goal, or nothing. A null action is a refusal."""
    g = F.lower(goal)
    none = F.lit(None).cast(ACTION)
    done = lambda kind, e: F.exists(F.coalesce(history, F.array().cast(HISTORY)), lambda h: (h["type"] == kind) & h["index"].eqNullSafe(e["i"]))
    fields = F.filter(elements, lambda e: e["tag"].isin("input", "textarea") & e["sensitive"].isNull() & ~done("type", e) & F.coalesce(~e["filled"], F.lit(False)))
    field = F.try_element_at(fields, F.lit(1))
    blocked = F.try_element_at(F.filter(elements, lambda e: e["sensitive"].isNotNull()), F.lit(1))
    words = goal_words(goal)

    def score(e: Column) -> Column:
        label = F.lower(F.regexp_replace(F.coalesce(e["label"], F.lit("")), r"\[\[[A-Z_]+\]\]", " "))
        return F.size(F.array_intersect(words, F.regexp_extract_all(label, F.lit(r"(?U)\w+"), F.lit(0))))

    clickable = F.filter(elements, lambda e: e["tag"].isin("a", "button") | F.coalesce(e["role"].isin("button", "link"), F.lit(False)))
    ranked = F.array_sort(F.transform(clickable, lambda e, k: F.struct((-score(e)).alias("s"), k.alias("k"), e.alias("e"))))
    top = F.try_element_at(F.filter(ranked, lambda r: r["s"] < 0), F.lit(1))
    wants = F.lit(False)
    for word in ("fill", "type", "enter", "search"):
        wants = wants | g.contains(word)
    plan = lambda action, reason: F.struct(action.alias("action"), reason.alias("reason"))
    named = F.coalesce(F.nullif(F.substring(field["label"], 1, 40), F.lit("")), field["type"], F.lit(""))
    return (
        F.when(g.contains("summar"), plan(_action("noop"), F.concat(F.lit("Summarised "), F.length(text), F.lit(" redacted chars."))))
        .when(g.contains("scroll"), plan(_action("scroll", dy=500), F.lit("Goal asks to scroll.")))
        .when(wants & g.rlike(jvm(SENSITIVE_GOAL)), plan(none, F.lit("Refusing: the goal names a sensitive field. The user must fill it.")))
        .when(wants & field.isNotNull(), plan(_action("type", field["i"], F.trim(F.substring_index(goal, ":", -1))), F.concat(F.lit("Filling empty field "), field["i"], F.lit(" ("), named, F.lit(")."))))
        .when(wants & blocked.isNotNull(), plan(none, F.concat(F.lit("Refusing: only remaining field "), blocked["i"], F.lit(" is "), blocked["sensitive"], F.lit(". User must fill it."))))
        .when(
            top.isNotNull() & ~F.coalesce(done("click", top["e"]), F.lit(False)),
            plan(_action("click", top["e"]["i"]), F.concat(F.lit("Clicking "), top["e"]["i"], F.lit(" ("), F.substring(top["e"]["label"], 1, 40), F.lit("), "), -top["s"], F.lit(" keyword match(es)."))),
        )
        .otherwise(plan(_action("noop"), F.lit("No confident action.")))
    )


def confident(plan: Column) -> Column:
    """A refusal is a decision; a shrug isn't."""
    return plan["action"].isNull() | ~((plan["action"]["type"] == "noop") & F.lower(plan["reason"]).contains("no confident action"))


def reply_action(raw: Column) -> Column:
    """The first JSON object in free text as an action; null if there is none."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "type string, index int, text string, dy int")


def valid_action(action: Column, elements: Column) -> Column:
    """Whether a planner may be obeyed: a known type, an element that exists, never a sensitive one to type into."""
    target = F.try_element_at(F.filter(elements, lambda e: e["i"] == action["index"]), F.lit(1))
    points = action["type"].isin("click", "type")
    ok = (
        action["type"].isin("click", "type", "scroll", "noop")
        & (~points | target.isNotNull())
        & ~((action["type"] == "type") & (target["sensitive"].isNotNull() | action["text"].isNull()))
    )
    return F.coalesce(ok, F.lit(False))


def decide(goal: Column, text: Column, elements: Column, history: Column, reply: Column) -> Column:
    """The tiers: rules first; a refusal ends it; a model's valid reply replaces a shrug; else the rules' plan."""
    rules, action = choose_action(goal, text, elements, history), reply_action(reply)
    return F.when(confident(rules), rules).when(valid_action(action, elements), F.struct(action.alias("action"), F.lit("Model.").alias("reason"))).otherwise(rules)


def request_problems(goal: Column, text: Column, elements: Column, screenshot: Column, history: Column) -> Column:
    """Names of the bounds a request breaks; it is refused if there is any."""
    tests = {
        "goal": F.coalesce(F.length(goal) > 2000, F.lit(True)),
        "text": F.length(text) > 32_000,
        "elements": F.size(elements) > 500,
        "screenshot": F.length(screenshot) > 8_000_000,
        "history": F.size(history) > 32,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items())))


def leaks(payload: Column, secrets: Column) -> Column:
    """The secrets a payload holds."""
    return F.filter(secrets, lambda s: F.contains(payload, s))


def clean_payload(payload: Column, secrets: Column, decoys: Column) -> Column:
    """Whether a payload holds no secret and all decoys."""
    return (F.size(leaks(payload, secrets)) == 0) & F.forall(decoys, lambda d: F.contains(payload, d))


def step_summary(steps: Column) -> Column:
    """What a run reports of its steps (action, reason, executed, ms, spans, elements): numbered from 1, with the redactions of both sorts summed."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    keep = ("action", "reason", "executed", "ms")
    return F.transform(steps, lambda s, i: F.struct((i + 1).alias("n"), *(s[k].alias(k) for k in keep), (zero(s["spans"]) + zero(s["elements"])).alias("redacted")))


def signature(action: Column) -> Column:
    """type:index:text:dy with - for what is null; none without an action."""
    part = lambda k: F.coalesce(action[k].cast("string"), F.lit("-"))
    return F.when(action.isNull(), F.lit("none")).otherwise(F.concat_ws(":", *(part(k) for k in ("type", "index", "text", "dy"))))


def replay(steps: DataFrame, most: int = STEPS, stall: int = STALL, run: str = "run_id", order: str = "n") -> DataFrame:
    """(run_id, stopped_at, reason) from (run_id, n, signature, kind, executed): where the loop ends, by the first rule that holds at a step."""
    w = Window.partitionBy(run).orderBy(order)
    rows = steps.withColumn("nth", F.row_number().over(w)).withColumn("same", F.coalesce(F.lag("signature").over(w) == F.col("signature"), F.lit(False)))
    island = F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w)
    rows = rows.withColumn("island", island).withColumn("stalls", F.sum(F.col("same").cast("int")).over(Window.partitionBy(run, "island").orderBy(order)))
    why = (
        F.when(F.coalesce(F.col("kind") == "noop", F.lit(True)), "done")
        .when(~F.coalesce(F.col("executed"), F.lit(False)), "action failed")
        .when(F.col("stalls") >= stall, "stalled")
        .when(F.col("nth") == most, "done" if most == 1 else "limit")
    )
    rows = rows.filter(F.col("nth") <= most).withColumn("why", why)
    ends = rows.groupBy(run).agg(F.min(F.when(F.col("why").isNotNull(), F.struct("nth", "why"))).alias("stop"), F.max("nth").alias("last"))
    return ends.select(run, F.coalesce("stop.nth", "last").cast("int").alias("stopped_at"), F.coalesce("stop.why", F.lit("open")).alias("reason"))
