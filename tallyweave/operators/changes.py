"""Change between two records of a patient: by lead, as one row with all channels, as a text, and claims of a text held against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["prior_id", "current_id"]
#: A level of so many millivolts or more is abnormal.
BAR = 0.1
#: Words of direction in a text, and the sign that they claim.
DIRECTIONS = {"longer": 1, "lengthened": 1, "increased": 1, "shorter": -1, "shortened": -1, "decreased": -1}


def lead_changes(pairs: DataFrame, levels: DataFrame, floor: float = 0.12) -> DataFrame:
    """prior_id, current_id, lead, prior, current, diff, significant, direction for leads that both records have.

    A change is significant beyond ``floor`` (strict). Every rise reads
    'elevated', a fall reads 'depressed' only where it is significant, as the
    rule to be matched has it. Null levels take no part. Pairs meet the lists
    of both records' leads, which are matched where they are.
    """
    lists = levels.where("level is not null").groupBy("record_id").agg(F.collect_list(F.struct("lead", "level")).alias("levels"))
    side = lambda s: lists.select(F.col("record_id").alias(f"{s}_id"), F.col("levels").alias(f"_{s}"))
    j = pairs.select(*PAIR).join(side("prior"), "prior_id").join(side("current"), "current_id")
    of = lambda a: F.transform(F.filter("_current", lambda b: b["lead"] == a["lead"]), lambda b: F.struct(a["lead"].alias("lead"), a["level"].alias("prior"), b["level"].alias("current")))
    j = j.select(*PAIR, F.explode(F.flatten(F.transform("_prior", of))).alias("m")).select(*PAIR, "m.*")
    d = F.col("current") - F.col("prior")
    j = j.withColumn("significant", F.abs(d) > floor).withColumn("diff", F.round(d, 4))
    return j.withColumn("direction", F.when(d > 0, "elevated").when(F.col("significant"), "depressed").otherwise("unchanged"))


def delta_rows(pairs: DataFrame, intervals: DataFrame, leads: DataFrame, findings: DataFrame, studies: DataFrame) -> DataFrame:
    """Each pair with ``changes``, ``caveats`` and ``any_change``.

    ``intervals`` as of the gated changes, ``leads`` as of ``lead_changes``,
    ``findings`` with label, change and rhythm, ``studies`` with record_id,
    beats and quality. The rows of a channel become one list for each pair
    where they are, if they are dealt by pair or by one of its records; then
    the lists of all channels meet. ``changes`` is sorted by kind and name; a
    pair without any has an empty list. A study that is not 'ok', or built
    from 1 to 4 beats, gives a caveat; a missing one gives none.
    """
    shape = {"name": "string", "prior": "double", "current": "double", "diff": "double", "significant": "boolean", "direction": "string", "suppressed": "string", "rhythm": "boolean"}

    def rows(df, kind, **given):
        cols = [(given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in shape.items()]
        row = F.struct(F.lit(kind).alias("kind"), *cols)
        return df.select(*PAIR, row.alias("row")).groupBy(*PAIR).agg(F.collect_list("row").alias("rows"))

    same = lambda *names: {n: F.col(n) for n in names}
    every = rows(intervals, "interval", name=F.col("measure"), prior=F.col("prior_value"), current=F.col("current_value"), **same("diff", "significant", "direction", "suppressed"))
    every = every.unionByName(rows(leads, "lead", name=F.col("lead"), **same("prior", "current", "diff", "significant", "direction")))
    every = every.unionByName(rows(findings, "finding", name=F.col("label"), significant=F.lit(True), direction=F.col("change"), rhythm=F.col("rhythm")))
    found = every.groupBy(*PAIR).agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("changes"))
    out = pairs.join(found, PAIR, "left")
    for s in ("prior", "current"):
        out = out.join(studies.select(F.col("record_id").alias(f"{s}_id"), F.col("beats").alias(f"{s}_beats"), F.col("quality").alias(f"{s}_quality")), f"{s}_id", "left")
    flagged = [F.when(F.col(f"{s}_quality") != "ok", F.concat(F.lit(f"{s} study flagged "), F.col(f"{s}_quality"))) for s in ("prior", "current")]
    few = [F.when(F.col(f"{s}_beats").between(1, 4), F.concat(F.lit(f"{s} beat built from only "), F.col(f"{s}_beats").cast("string"), F.lit(" beats"))) for s in ("prior", "current")]
    changes = F.coalesce("changes", F.array())
    return out.withColumn("changes", changes).select(*pairs.columns, "changes", F.array_compact(F.array(*flagged, *few)).alias("caveats"), F.exists("changes", lambda x: F.coalesce(x["significant"], F.lit(False))).alias("any_change"))


def of_kind(kind: str, direction: str | None = None) -> Column:
    """The significant changes of a kind in ``changes``."""
    test = lambda x: (x["kind"] == kind) & F.coalesce(x["significant"], F.lit(False))
    return F.filter("changes", lambda x: test(x) & (x["direction"] == direction) if direction else test(x))


def names(items: Column) -> Column:
    return F.transform(items, lambda x: x["name"])


def listed(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def _lead_sentences() -> list[Column]:
    moved = of_kind("lead")
    low = lambda x: (x["current"] <= -BAR) & (x["diff"] < 0)
    high = lambda x: (x["current"] >= BAR) & (x["diff"] > 0)
    gone = lambda x: (F.abs(x["prior"]) >= BAR) & (F.abs(x["current"]) < BAR)
    mv = lambda x: F.format_string("%+.2f mV", x)
    out = []
    for test, word in ((low, "depression"), (high, "elevation")):
        group = F.filter(moved, test)
        worst = F.array_min(F.transform(group, lambda x: F.struct((-F.round(F.abs(x["diff"]), 4)).alias("d"), x["name"].alias("name"), x["prior"].alias("prior"), x["current"].alias("current"))))
        opener = F.when(F.exists(group, lambda x: F.abs(x["prior"]) >= BAR), "Increased").otherwise("New")
        lead = F.when(F.size(group) > 1, F.concat(worst["name"], F.lit(" "))).otherwise("")
        text = F.concat(opener, F.lit(f" ST-segment {word} in "), listed(names(group)), F.lit(" ("), lead, mv(worst["prior"]), F.lit(" to "), mv(worst["current"]), F.lit(")"))
        out.append(F.when(F.size(group) > 0, text))
    ended = F.filter(moved, gone)
    subtle = F.filter(moved, lambda x: ~(low(x) | high(x) | gone(x)))
    out.append(F.when(F.size(ended) > 0, F.concat(F.lit("Previously noted ST deviation in "), listed(names(ended)), F.lit(" has resolved"))))
    out.append(F.when(F.size(subtle) > 0, F.concat(F.lit("Sub-threshold ST shift in "), listed(names(subtle)))))
    return out


def change_narrative(deltas: DataFrame, sinus: str, keep: list[str] | None = None) -> DataFrame:
    """prior_id, current_id, report of each row of ``delta_rows`` with a ``prior_ts``, and its columns ``keep``.

    One rhythm out and one in is a transition ('reverted' where the new one is
    ``sinus``); other findings are listed. Shifts of leads are grouped by
    direction with a bar of 0.1 mV, the largest in brackets. Nothing to tell
    is said so, and measures that could not be compared are named.
    """
    whole = lambda x: F.round(x, 0).cast("long").cast("string")
    new, gone = of_kind("finding", "new"), of_kind("finding", "resolved")
    beats = lambda items: F.filter(items, lambda x: F.coalesce(x["rhythm"], F.lit(False)))
    d = deltas.withColumn("turn", (F.size(beats(new)) == 1) & (F.size(beats(gone)) == 1))
    rest = lambda items: names(F.filter(items, lambda x: ~(F.col("turn") & F.coalesce(x["rhythm"], F.lit(False)))))
    d = d.select("*", rest(new).alias("new"), rest(gone).alias("gone"), F.get(names(beats(new)), F.lit(0)).alias("into"), F.get(names(beats(gone)), F.lit(0)).alias("out"))
    verb = F.when(F.col("into") == sinus, " has reverted to ").otherwise(" has changed to ")
    told = [
        F.when(F.col("turn"), F.concat("out", verb, "into")),
        F.when(F.size("new") > 0, F.concat(F.lit("New since the prior study: "), listed(F.col("new")))),
        F.when(F.size("gone") > 0, F.concat(F.lit("No longer present: "), listed(F.col("gone")))),
    ]
    sign = lambda x: F.concat(F.when(F.round(x, 0) >= 0, "+").otherwise(""), whole(x))
    moved = F.transform(of_kind("interval"), lambda x: F.concat(F.lit("The "), x["name"], F.lit(" is "), x["direction"], F.lit(" from "), whole(x["prior"]), F.lit(" to "), whole(x["current"]), F.lit(" ("), sign(x["diff"]), F.lit(")")))
    st = F.array_compact(F.array(*_lead_sentences()))
    d = d.withColumn("st", st).withColumn("moved", moved).withColumn("body", F.concat(F.array_compact(F.array(*told)), "st", "moved"))
    header = F.concat(F.lit("Compared with the prior study of "), F.date_format("prior_ts", "yyyy-MM-dd"), F.lit(": "))
    comparison = F.concat(header, F.when(F.size("body") > 0, F.array_join("body", ". ")).otherwise("no significant change"), F.lit("."))
    first = F.get(names(new), F.lit(0))
    verdict = (
        F.when(first.isNotNull(), F.concat(F.lit("interval change, new "), first))
        .when(F.size("st") > 0, "new or evolving repolarization change")
        .when(F.size("moved") > 0, F.concat(listed(names(of_kind("interval"))), F.lit(" changed; no new finding")))
        .when(F.size("gone") > 0, "a finding is no longer present; otherwise no change")
        .otherwise("no significant change")
    )
    blocked = F.transform(F.filter("changes", lambda x: x["suppressed"].isNotNull()), lambda x: F.concat(x["name"], F.lit(": "), x["suppressed"]))
    lines = [comparison, F.concat(F.lit("Impression: "), verdict, F.lit("."))]
    lines += [F.when(F.size(x) > 0, F.concat(F.lit(t), F.array_join(x, "; "), F.lit("."))) for t, x in (("Not compared: ", blocked), ("Data quality: ", F.col("caveats")))]
    return d.select(*PAIR, F.array_join(F.array_compact(F.array(*lines)), "\n").alias("report"), *(keep or []))


def audit_claims(texts: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """prior_id, current_id, unsupported, consistent: claims of ``report`` that the row of ``delta_rows`` does not bear out. Texts with a column ``changes`` need no ``deltas``.

    New and resolved findings, transitions included, have to be among the
    changes of that kind. A measure said to have moved has to be significant
    and to have moved that way. The first clause of each kind is read; a null
    report claims nothing.
    """
    text = F.coalesce("report", F.lit(""))
    clause = lambda p: F.regexp_extract(text, p, 1)
    split = lambda t: F.filter(F.split(t, r", | and "), lambda x: x != "")
    new = F.concat(split(clause(r"New since the prior study: ([^.\n]*)")), split(clause(r"has (?:changed|reverted) to ([^.\n]*)")))
    gone = F.concat(split(clause(r"No longer present: ([^.\n]*)")), split(clause(r"[:.] ([^.:\n]*) has (?:changed|reverted) to")))
    beyond = lambda kind, said: F.transform(F.array_except(said, names(of_kind("finding", kind))), lambda x: F.concat(F.lit(f"{kind}:"), x))
    signs = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    word = lambda x: F.call_function("regexp_extract", text, F.concat(F.lit(r"The \Q"), x["name"], F.lit(r"\E is (\w+)")), F.lit(1))

    def claim(x):
        contrary = F.coalesce(F.try_element_at(signs, word(x)) * x["diff"] < 0, F.lit(False))
        return F.when(word(x) == "", None).when(~F.coalesce(x["significant"], F.lit(False)), F.concat(F.lit("interval:"), x["name"])).when(contrary, F.concat(F.lit("direction:"), x["name"]))

    j = texts if deltas is None else texts.join(deltas.select(*PAIR, "changes"), PAIR)
    spans = F.array_compact(F.transform(F.filter("changes", lambda x: x["kind"] == "interval"), claim))
    return j.select(*PAIR, F.array_sort(F.concat(beyond("new", new), beyond("resolved", gone), spans)).alias("unsupported")).withColumn("consistent", F.size("unsupported") == 0)
