"""Queries of the action audit and of run and thread logs (A1 to A11, U2, U3, U7, U9, U11) and their SQL.

The logs are derived from ``conversations``: each turn proposes two actions, picked by its ids and the length of its text, on
a form that each conversation has. ``FORM``, ``MOVES`` and ``HABITS`` are test data of our own; both sides read them as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions, runs
from ..sources.readers import spread, table

#: Elements of each conversation's form: id, role, label, context, value, kind of field, group, input type; then for visible,
#: enabled, required, checked and in a form of another site a modulus: 0 always, else for ids that it doesn't divide.
FORM = [
    ("el_1", "textbox", "Full name:", "", "", "NAME", None, "text", 0, 0, 0, 1, 1),
    ("el_2", "textbox", "PAN", "", "", "PAN", None, "text", 0, 0, 2, 1, 3),
    ("el_3", "password", "Password", "", "", None, None, "password", 0, 0, 1, 1, 1),
    ("el_4", "select", "State", "", "KA", None, None, "select", 0, 0, 1, 1, 1),
    ("el_5", "checkbox", "Agree", "", None, None, None, "checkbox", 0, 0, 0, 2, 1),
    ("el_6", "button", "Submit order", "", None, None, None, "button", 0, 4, 1, 1, 1),
    ("el_7", "button", "Pay now", "", None, None, None, "button", 5, 0, 1, 1, 1),
    ("el_8", "textbox", "Notes", "", "<PII_PAN_1>", None, None, "text", 0, 0, 1, 1, 1),
    ("el_9", "textbox", "Mobile", "", "", "PHONE", None, "tel", 1, 0, 1, 1, 1),
    ("el_10", "radio", "Small", "Size :", None, None, "size", "radio", 0, 0, 1, 1, 1),
    ("el_11", "radio", "Large", "Size :", None, None, "size", "radio", 0, 0, 1, 3, 1),
    ("el_12", "textbox", "", "Born on:", "", None, None, "date", 7, 0, 1, 1, 1),
]
OPTIONS = [("KA", "Karnataka"), ("MH", "Maharashtra")]
#: Kind, target, value, text and scroll distance of what a turn may propose; an unfinished line stands for one that is no JSON.
MOVES = [
    ("click", "el_6", None, None, None), ("click", "[el_6].", None, None, None), ("type", "el_1", "<PII_NAME_1>", None, None), ("type", "el_2", "<PII_PAN_1>", None, None), ("type", "el_1", "<PII_PAN_1>", None, None),
    ("type", "el_2", "ABCPE1234F", None, None), ("type", "el_3", "x", None, None), ("type", "el_4", "maharashtra", None, None), ("select", "el_5", "yes", None, None), ("click", "el_4", None, None, None),
    ("type", "el_6", "hello", None, None), ("type", "el_1", "", None, None), ("type", "el_8", "hello", None, None), ("type", "el_9", "x", None, None), ("click", "el_99", None, None, None),
    ("click", None, None, None, None), ("scroll", None, None, None, 100.0), ("scroll", None, None, None, 30000.0), ("ask_user", None, None, "Which one?", None), ("ask_user", None, None, " ", None),
    ("answer", None, None, "Done as asked.", None), ("done", None, None, None, None), ("wait", None, None, None, None), ("fly", None, None, None, None), ("type", "el_12", "2001-02-03", None, None), ("click", "el_7", None, None, None),
]
#: What a conversation proposes again each turn.
HABITS = [("select", "el_4", "KA", None, None), ("type", "el_1", "<PII_NAME_1>", None, None), ("click", "el_6", None, None, None), ("type", "el_2", "<PII_PAN_1>", None, None), ("select", "el_10", "on", None, None)]
CUT = '{"kind": "click", "target"'


def _holds(key: Column, modulus: int) -> Column:
    return F.pmod(key, F.lit(modulus)) != 0 if modulus else F.lit(True)


def _picked(choices: list[tuple], nth: Column) -> Column:
    fields = ("kind", "target", "value", "text", "scrollDelta")
    rows = F.array(*(F.struct(*(F.lit(x).cast("double" if f == "scrollDelta" else "string").alias(f) for f, x in zip(fields, c))) for c in choices))
    return rows[F.pmod(nth, F.lit(len(choices))).cast("int")]


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, turn, idx, executed and ``raw``, the action as JSON: two rows a turn."""
    rows = spread(table(spark, sf_dir, "conversations"))
    size = F.coalesce(F.length("text"), F.lit(0))
    run, turn = F.col("conv_id"), F.col("turn")
    reason = F.concat(F.lit("turn "), turn.cast("string"))
    line = lambda a: F.to_json(F.struct(a["kind"].alias("kind"), a["target"].alias("target"), a["value"].alias("value"), a["text"].alias("text"), a["scrollDelta"].alias("scrollDelta"), reason.alias("reasoning")))
    first = F.when(F.pmod(size, F.lit(29)) == 0, F.lit(CUT)).otherwise(line(_picked(MOVES, run * 5 + turn * 7 + size)))
    both = F.array(F.struct(F.lit(0).alias("idx"), first.alias("raw")), F.struct(F.lit(1).alias("idx"), line(_picked(HABITS, run)).alias("raw")))
    return rows.select(run.alias("run_id"), turn, (F.pmod(turn, F.lit(4)) != 3).alias("executed"), F.inline(both))


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's actions as ``actions.validated`` takes them; those that don't conform are left to A1."""
    found = actions.parsed(raw_log(spark, sf_dir)).where("action.kind is not null")
    return found.select("run_id", "turn", "idx", F.col("run_id").alias("page_id"), "action.kind", "action.target", "action.value", "action.text", F.col("action.scrollDelta").alias("scroll_delta"), "action.reasoning", "executed")


def form_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of every conversation, a row an element."""
    key = F.col("page_id")
    names = ("node_id", "role", "label", "context_label", "value", "field_kind", "grp", "input_type")
    options = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(t).alias("label")) for v, t in OPTIONS))
    rows = [
        F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(names, f)), F.lit(k).alias("node_seq"), *(_holds(key, m).alias(n) for n, m in zip(("visible", "enabled", "required", "checked", "cross_origin_form"), f[8:])), (options if f[1] == "select" else F.slice(options, 1, 0)).alias("options"))
        for k, f in enumerate(FORM)
    ]
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id")).distinct().select("page_id", F.inline(F.array(*rows)))


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a conversation's page knows: a PAN always, a name where the id is even."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id")).distinct()
    tokens = F.when(F.pmod("page_id", F.lit(2)) == 0, F.array(F.lit("<PII_PAN_1>"), F.lit("<PII_NAME_1>"))).otherwise(F.array(F.lit("<PII_PAN_1>")))
    return ids.select("page_id", F.explode(tokens).alias("token"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.validated(action_log(spark, sf_dir), form_nodes(spark, sf_dir), placeholders(spark, sf_dir))


def a1_conforming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: lines of the log by kind (null: no action), and how many have all that their kind requires."""
    found = actions.parsed(raw_log(spark, sf_dir))
    return found.groupBy(F.col("action.kind").alias("kind")).agg(F.count(F.lit(1)).alias("lines"), F.count_if("conforms").alias("conforming"))


def a3_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every action."""
    return _validated(spark, sf_dir).select("run_id", "turn", "idx", "kind", "allowed", "reason", "normalised", "new_value", "question")


def a7_submit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.submit_candidates(form_nodes(spark, sf_dir)).select("page_id", "submit_id", "submit_label")


def a9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.report(_validated(spark, sf_dir)).select("allowed", "reason", "actions")


def a10_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.missing_fields(form_nodes(spark, sf_dir)).select("page_id", "id", "label", "kind", "required", "input_type", "options")


def a11_still_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that were missing, and still are once the allowed and executed actions of the run have filled theirs."""
    nodes = form_nodes(spark, sf_dir)
    done = _validated(spark, sf_dir).where("allowed and executed").select(F.col("page_id").alias("__p"), actions.bare_target(F.col("target")).alias("__n"), "normalised", "new_value", "turn", "idx")
    last = done.where("normalised in ('type', 'click')").groupBy("__p", "__n").agg(F.max_by(F.when(F.col("normalised") == "type", F.col("new_value")), F.struct("turn", "idx")).alias("__v"))
    fresh = nodes.join(last, (F.col("page_id") == F.col("__p")) & (F.col("node_id") == F.col("__n")), "left")
    fresh = fresh.withColumn("value", F.coalesce("__v", "value")).withColumn("checked", F.col("checked") | F.col("__p").isNotNull())
    return actions.still_missing(actions.missing_fields(nodes), actions.missing_fields(fresh)).select("page_id", "id", "label", "kind")


def _run_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By run and turn how its actions ended; a turn whose first line is no JSON counts as a failed one."""
    broken = raw_log(spark, sf_dir).groupBy("run_id", "turn").agg(F.bool_or(F.col("raw") == CUT).alias("failed"))
    ok = lambda kind: F.coalesce(F.bool_or(F.col("allowed") & (F.col("kind") == kind)), F.lit(False))
    ends = _validated(spark, sf_dir).groupBy(F.col("run_id").alias("__r"), F.col("turn").alias("__t")).agg(
        F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"), ok("answer").alias("answered"), ok("ask_user").alias("asked"), ok("done").alias("finished"), F.bool_or(F.col("question").isNotNull()).alias("remedy"), F.max("question").alias("question"),
    )
    rows = broken.join(ends, (F.col("run_id") == F.col("__r")) & (F.col("turn") == F.col("__t"))).drop("__r", "__t")
    return rows.withColumn("opaque", F.lit(False)).withColumn("left", F.lit(False))


def u2_stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stop_reasons(_run_turns(spark, sf_dir)).select("run_id", "turn", "reason")


def u3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.history(_validated(spark, sf_dir)).select("run_id", "turn", "idx", "line")


def thread_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_id, at, summary, withheld (tokens allowed into fields), reason and question of every turn."""
    tokens = _validated(spark, sf_dir).where(F.col("allowed") & F.col("new_value").startswith("<PII_")).groupBy(F.col("run_id").alias("__r"), F.col("turn").alias("__t")).agg(F.count(F.lit(1)).alias("withheld"))
    rows = _run_turns(spark, sf_dir).join(tokens, (F.col("run_id") == F.col("__r")) & (F.col("turn") == F.col("__t")), "left")
    reason = F.when(F.col("answered"), "answered").when(F.col("asked"), "ask-user").when(F.col("finished"), "done").when(F.col("remedy"), "needs-user-input").otherwise("open")
    return rows.select(F.col("run_id").alias("thread_id"), F.col("turn").alias("at"), F.concat(F.lit("allowed "), F.col("allowed").cast("string")).alias("summary"), F.coalesce("withheld", F.lit(0)).cast("long").alias("withheld"), reason.alias("reason"), F.when(F.col("asked"), "Which one?").otherwise(F.col("question")).alias("question"))


def u7_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = runs.fold_threads(thread_turns(spark, sf_dir))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["at"].cast("string"), F.lit(":"), t["summary"])), ",")
    return folded.select("thread_id", told.alias("turns"), "status", "pending", "created_at", "updated_at", "withheld")


def u9_thread_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits to all pages, where threads know the origins of every fourth page and every third visit goes on from its own."""
    rows = table(spark, sf_dir, "pages")
    visits = rows.select("page_id", "url", F.when(F.pmod("page_id", F.lit(3)) == 0, runs.web_origin(F.col("url"))).alias("active_origin"))
    threads = rows.where("page_id % 4 = 0").select(runs.web_origin(F.col("url")).alias("origin"))
    return runs.thread_verdicts(visits, threads).select("page_id", "origin", "verdict")


def u11_question_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the targets of actions that were refused, from the first turn that shows them; a form shows its labels from turn 1 on where the id is odd."""
    asked = _validated(spark, sf_dir).where("not allowed and target is not null").select("run_id", "turn", "idx", actions.bare_target(F.col("target")).alias("node_id"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), "turn").distinct()
    shown = turns.join(form_nodes(spark, sf_dir).select("page_id", "node_id", "label"), F.col("run_id") == F.col("page_id"))
    label = F.when((F.col("turn") > 0) | (F.pmod("run_id", F.lit(2)) == 0), F.concat("label", F.lit(" at "), F.col("turn").cast("string")))
    return runs.question_labels(asked, shown.select("run_id", "node_id", "turn", label.alias("label"))).select("run_id", "turn", "idx", "node_id", "label")


QUERIES = [a1_conforming, a3_verdicts, a7_submit_candidates, a9_report, a10_missing_fields, a11_still_missing, u2_stop_reasons, u3_history, u7_threads, u9_thread_verdicts, u11_question_labels]


def _value(x: object) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_value, (k, *r))) + ")" for k, r in enumerate(rows))


def oracle_sql() -> dict[str, str]:
    true = lambda m: f"({m} = 0 or page_id % greatest({m}, 1) <> 0)"
    sends = "regexp_matches(label, '(?i)\\b(submit|send|order|place|confirm|continue|save|pay|book|apply)\\b')"
    options = ", ".join(f"{{'value': '{v}', 'label': '{t}'}}" for v, t in OPTIONS)
    log = f"""with move(k, kind, target, value, text, delta) as (values {_values(MOVES)}), habit(k, kind, target, value, text, delta) as (values {_values(HABITS)}),
        form(node_seq, node_id, role, label, context_label, value, field_kind, grp, input_type, vm, em, rm, cm, xm) as (values {_values(FORM)}),
        c as (select conv_id as run_id, turn, turn % 4 <> 3 as executed, coalesce(length(text), 0) as size, 'turn ' || turn as reasoning from conversations),
        lines as (select run_id, turn, 0 as idx, executed, reasoning, m.* exclude (k), size % 29 = 0 as cut from c join move m on m.k = (run_id * 5 + turn * 7 + size) % {len(MOVES)}
            union all select run_id, turn, 1, executed, reasoning, h.* exclude (k), false from c join habit h on h.k = run_id % {len(HABITS)}),
        acts as (select *, run_id as page_id, regexp_replace(regexp_replace(trim(target), '^[\\[(]+', ''), '[\\]).,]+$', '') as aim from lines where not cut),
        nodes as (select page_id, form.* exclude (vm, em, rm, cm, xm), {true('vm')} as visible, {true('em')} as enabled, {true('rm')} as required, {true('cm')} as checked, {true('xm')} as crosses from (select distinct conv_id as page_id from conversations), form),
        known as (select distinct conv_id as page_id, '<PII_PAN_1>' as token from conversations union all select distinct conv_id, '<PII_NAME_1>' from conversations where conv_id % 2 = 0),
        met as (select a.*, n.node_id, n.role, n.label as n_label, n.value as held, n.visible, n.enabled, n.field_kind, n.crosses, k.token is not null as told,
            (select max(o.value) from (select unnest([{options}]) as o) where n.role = 'select' and (lower(o.value) = lower(a.value) or lower(o.label) = lower(a.value))) as choice,
            count(*) filter (executed) over (partition by run_id, kind, aim, a.value order by turn, idx rows between unbounded preceding and 1 preceding) as before, regexp_extract(a.value, '^<PII_([A-Z_]+)_[0-9]+>$', 1) as token_kind
            from acts a left join nodes n on a.page_id = n.page_id and a.aim = n.node_id left join known k on a.page_id = k.page_id and a.value = k.token),
        why as (select *, kind = 'type' and role = 'select' and choice is not null as selects, kind = 'select' and role in ('radio', 'checkbox') as clicks from met),
        said as (select *, case when kind not in ('click', 'type', 'select', 'scroll', 'wait', 'done', 'ask_user', 'answer') then 'kind-unknown:' || kind
            when regexp_matches(value, '\\b[A-Z]{{3}}[PCHFATBLJG][A-Z][0-9]{{4}}[A-Z]\\b') then 'raw-value:PAN'
            when kind in ('wait', 'done') then null when kind = 'ask_user' then case when trim(text) = '' then 'question-empty' end when kind = 'answer' then case when trim(text) = '' then 'answer-empty' end
            when kind = 'scroll' then case when abs(delta) > 20000 then 'scroll-out-of-range' end
            when target is null then 'target-missing:' || kind when node_id is null then 'target-unknown:' || target when not visible then 'target-hidden:' || aim when not enabled then 'target-disabled:' || aim
            when before > 0 and held is not distinct from value then 'nothing-to-change:' || aim when before > 1 and held is distinct from value then 'without-effect:' || aim
            when clicks then null when kind = 'click' and role = 'select' then 'wants-select:' || aim when kind <> 'type' or coalesce(selects, false) then null
            when role = 'password' then 'never-typed:password' when role <> 'textbox' then 'takes-no-text:' || aim || ':' || role when value = '' then 'value-empty'
            when token_kind <> '' and not told then 'token-unknown:' || value when token_kind <> '' and crosses then 'token-leaves-site:' || aim
            when token_kind <> '' and token_kind is distinct from field_kind then 'token-kind:' || token_kind || ':in:' || coalesce(field_kind, 'none')
            when token_kind = '' and starts_with(held, '<PII_') then 'holds-withheld-value:' || aim end as reason from why),
        v as (select *, reason is null as allowed, case when clicks then 'click' when selects then 'select' else kind end as normalised, case when selects then choice else value end as new_value,
            case when starts_with(reason, 'token-unknown:') then case when n_label <> '' then 'What is your ' || n_label || '?' else 'Which value belongs in this field?' end end as question from said),
        turns as (select run_id, turn, bool_or(l.cut) as failed, count(*) filter (v.allowed) as allowed, count(*) filter (not v.allowed) as denied, coalesce(bool_or(v.allowed and v.kind = 'answer'), false) as answered,
            coalesce(bool_or(v.allowed and v.kind = 'ask_user'), false) as asked, coalesce(bool_or(v.allowed and v.kind = 'done'), false) as finished, max(question) as question, count(*) filter (v.allowed and starts_with(new_value, '<PII_')) as withheld
            from lines l left join v using (run_id, turn, idx) group by 1, 2),"""
    missing = lambda name, source: f"""{name} as (select page_id, node_id as id, regexp_replace(case when label <> '' then label when context_label <> '' then context_label else 'this field' end, '\\s*:\\s*$', '') as label, 'text' as kind, required,
            case when input_type in ('time', 'date', 'datetime-local', 'month', 'week', 'email', 'number', 'tel', 'url', 'search', 'color', 'range', 'text') then input_type else 'text' end as input_type, 0 as options
            from {source} where visible and enabled and role = 'textbox' and trim(coalesce(value, '')) = ''
            union all select page_id, arg_min(node_id, node_seq), coalesce(nullif(regexp_replace(max(context_label), '\\s*:\\s*$', ''), ''), max(grp), 'Choose one'), 'choice', bool_or(required), 'text', count(*)::int
            from {source} where visible and enabled and role in ('radio', 'checkbox') group by page_id, coalesce(grp, '#' || node_id) having not bool_or(checked))"""  # noqa: E731
    needs = {"click": "target is not null", "type": "target is not null and value is not null", "select": "target is not null and value is not null", "scroll": "delta is not null", "ask_user": "text is not null", "answer": "text is not null", "wait": "true", "done": "true"}
    conforms = " ".join(f"when kind = '{k}' then {c}" for k, c in needs.items())
    ends = """case when failed then 'server-error' when answered then 'answered' when asked then 'ask-user' when finished then 'done' when refused and question is not null then 'needs-user-input'
            when refused and (coalesce(lag(refused) over (partition by run_id order by turn), false) or turn >= 4) then 'nothing-executable' end"""
    status = "case when answered then 'answered' when asked then 'ask-user' when finished then 'done' when question is not null then 'needs-user-input' else 'open' end"
    # An origin: scheme and host in lower case, and a port that isn't the scheme's own.
    origin = r"""case when regexp_matches(url, '(?i)^https?://') and regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1) <> '' then lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1))
            || regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:]+(:[0-9]+)', 1)), case when lower(url) like 'http:%' then '^:80$' else '^:443$' end, ''), '^:$', '') end"""
    return {
        "a1_conforming": f"{log} e as (select case when not cut then kind end as kind, not cut and case {conforms} else false end as ok from lines) select kind, count(*) as lines, count(*) filter (ok) as conforming from e group by 1",
        "a3_verdicts": f"{log} z as (select 1) select run_id, turn, idx, kind, allowed, reason, normalised, new_value, question from v",
        "a7_submit_candidates": f"{log} z as (select page_id, node_id, label from nodes where role = 'button' and visible and enabled and {sends}) select page_id, max(node_id) as submit_id, max(label) as submit_label from z group by 1 having count(*) = 1",
        "a9_report": f"{log} z as (select 1) select allowed, reason, count(*) as actions from v group by 1, 2",
        "a10_missing_fields": f"{log} {missing('z', 'nodes')} select * from z",
        "a11_still_missing": f"""{log} last as (select page_id, aim as node_id, arg_max(struct_pack(w := case when normalised = 'type' then new_value end), (turn, idx)).w as w from v where allowed and executed and normalised in ('type', 'click') group by 1, 2),
            fresh as (select n.* replace (coalesce(l.w, n.value) as value, n.checked or l.page_id is not null as checked) from nodes n left join last l using (page_id, node_id)), {missing('was', 'nodes')}, {missing('now', 'fresh')}
            select page_id, id, label, kind from now semi join was using (page_id, id)""",
        "u2_stop_reasons": f"{log} f as (select *, allowed = 0 and denied > 0 as refused from turns), w as (select run_id, turn, {ends} as why from f) select run_id, coalesce(min(turn) filter (why is not null), max(turn)) as turn, coalesce(arg_min(why, turn) filter (why is not null), 'max-turns') as reason from w group by 1",
        "u3_history": f"{log} z as (select 1) select run_id, turn, idx, case when allowed then '' else 'REFUSED (' || reason || ') ' end || reasoning as line from v",
        "u7_threads": f"""{log} f as (select run_id, turn, allowed, withheld, {status} as reason, case when asked then 'Which one?' else question end as question from turns where allowed + denied > 0)
            select run_id as thread_id, string_agg(turn || ':allowed ' || allowed, ',' order by turn) as turns, case when arg_max(reason, turn) in ('done', 'answered') then 'done' else 'open' end as status,
            arg_max(struct_pack(q := case when reason in ('ask-user', 'needs-user-input') then question end), turn).q as pending, min(turn) as created_at, max(turn) as updated_at, sum(withheld)::bigint as withheld from f group by 1""",
        "u9_thread_verdicts": f"with p as (select page_id, {origin} as origin from pages), t as (select distinct origin as o from p where page_id % 4 = 0) select page_id, origin, case when origin is null then 'internal' when page_id % 3 = 0 then 'continue' when o is not null then 'resume' else 'new' end as verdict from p left join t on origin = o",
        "u11_question_labels": f"{log} s as (select n.page_id as run_id, node_id, label, case when n.page_id % 2 = 0 then min(turn) else min(turn) filter (turn > 0) end as first from nodes n join conversations c on n.page_id = c.conv_id group by n.page_id, node_id, label) select v.run_id, turn, idx, aim as node_id, case when first is not null then s.label || ' at ' || first end as label from v left join s on v.run_id = s.run_id and v.aim = s.node_id where not allowed and target is not null",
    }
