"""Documents of records: nested exports, one-line impressions, training examples and their prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import uniform
from .narratives import AXES, render_reports, structured_findings

# Code systems, and code, display, unit and unit code of each measure.
LOINC, ICD, UNITS = "http://loinc.org", "http://hl7.org/fhir/sid/icd-10-cm", "http://unitsofmeasure.org"
CATEGORY, SECTION, READING = (f"http://terminology.hl7.org/CodeSystem/{x}" for x in ("observation-category", "v2-0074", "v3-ObservationInterpretation"))
MEASURES = {
    "heart_rate": ("8867-4", "Heart rate", "beats/minute", "/min"), "pr": ("8625-6", "P-R Interval", "milliseconds", "ms"),
    "qrs": ("8633-0", "QRS duration", "milliseconds", "ms"), "qt": ("8634-8", "Q-T interval", "milliseconds", "ms"),
    "qtc_fridericia": ("8636-3", "Q-T interval corrected", "milliseconds", "ms"),
}
# Wording and limits of the one-line impression, groups by falling consequence.
ATTRIBUTION = "computer-assisted interpretation, requires physician confirmation"
REVIEW_CLAUSE = "low-confidence findings flagged for review"
CONSEQUENCE = ("infarction", "repolarization", "conduction", "rhythm", "pacing", "ectopy", "chamber", "normal", "technical")
MAX_CHARS, MAX_FINDINGS = 300, 4
# Share of low draws, and the ranges that confidences are drawn from.
LOW_SHARE, HIGH_RANGE, LOW_RANGE = 0.15, (0.82, 0.99), (0.30, 0.49)

_CONCEPT = "struct<coding:array<struct<system:string,code:string,display:string>>,text:string>"
_REF = "struct<reference:string>"
#: Fields of any resource; those that a resource lacks are null and left out of its JSON.
_RESOURCE = {
    "resourceType": "string", "status": "string", "identifier": "array<struct<system:string,value:string>>", "deviceName": "array<struct<name:string,type:string>>",
    "type": _CONCEPT, "version": "array<struct<value:string>>", "category": f"array<{_CONCEPT}>", "code": _CONCEPT, "subject": _REF, "effectiveDateTime": "string", "issued": "string",
    "valueCodeableConcept": _CONCEPT, "valueQuantity": "struct<value:double,unit:string,system:string,code:string>", "interpretation": f"array<{_CONCEPT}>", "device": _REF,
    "note": "array<struct<text:string>>", "extension": "array<struct<url:string,valueDecimal:double,valueBoolean:boolean,valueReference:struct<reference:string>>>",
    "result": f"array<{_REF}>", "conclusion": "string", "conclusionCode": f"array<{_CONCEPT}>",
}
BUNDLE = f"struct<resourceType:string,type:string,timestamp:string,entry:array<struct<fullUrl:string,resource:struct<{','.join(f'{k}:{t}' for k, t in _RESOURCE.items())}>>>>"


def _resource(**fields: Column) -> Column:
    return F.struct(*[(fields.get(k, F.lit(None))).cast(t).alias(k) for k, t in _RESOURCE.items()])


def _concept(*codings: tuple, text: Column | None = None) -> Column:
    code = lambda c: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(("system", "code", "display"), c, strict=True)])
    last = codings[0][2]
    return F.struct(F.array(*map(code, codings)).alias("coding"), (text if text is not None else last if isinstance(last, Column) else F.lit(last)).alias("text"))


def _urn(*key: Column | str) -> Column:
    """A stable URN from a key: the same in every run and for every partitioning."""
    h = F.md5(F.concat_ws("|", *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _ref(url: Column) -> Column:
    return F.struct(url.alias("reference"))


def nested_bundles(records: DataFrame, findings: DataFrame, measures: DataFrame, mapping: DataFrame, *, system: str = "urn:codes", extension: str = "urn:extension") -> DataFrame:
    """record_id, status, bundle: one nested JSON document for each record.

    ``records``: record_id, subject (a reference of the caller's, or null),
    effective, issuer_version, review, conclusion. ``findings``: record_id,
    code, display, confidence, needs_review, leads. ``measures``: record_id,
    name, value; unknown names and null values have no entry. ``mapping``:
    code, target, display, tier; targets of null are not coded, and the report
    names each target once, definitional ones first.

    Entries stand as device, report, patient (only without ``subject``),
    findings by code, measures in fixed order; the report refers to all of the
    latter. It is preliminary if review is recommended, else final. Names are
    URNs of (record, kind, code). The four tables meet in one aggregation;
    a record without findings or measures still has its device and report.
    """
    subject = F.coalesce("subject", _urn(F.col("record_id"), "patient"))
    head = records.select("record_id", F.lit(0).alias("part"), F.lit("").alias("key"), F.struct("subject", "effective", "issuer_version", "review", "conclusion").alias("head"))
    named = findings.join(mapping.where("target is not null").select("code", F.col("target"), F.col("display").alias("mapped"), (F.col("tier") != "definitional").alias("later")), "code", "left")
    rows = named.select(
        "record_id", F.lit(1).alias("part"), F.col("code").alias("key"),
        F.struct(F.col("display"), F.col("confidence").cast("double").alias("confidence"), "needs_review", "leads", "target", "mapped", "later").alias("finding"),
    )
    order = F.create_map(*[x for k, name in enumerate(MEASURES) for x in (F.lit(name), F.lit(str(k)))])
    values = measures.where(F.col("name").isin(*MEASURES) & F.col("value").isNotNull())
    values = values.select("record_id", F.lit(2).alias("part"), F.concat(order[F.col("name")], F.col("name")).alias("key"), F.round(F.col("value").cast("double"), 1).alias("value"))
    every = head.unionByName(rows, allowMissingColumns=True).unionByName(values, allowMissingColumns=True)
    g = every.groupBy("record_id").agg(F.max("head").alias("h"), F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("part", "key", "finding", "value")))).alias("items")).where("h is not null")
    g = g.select("record_id", "h.*", "items")

    device, report = _urn(F.col("record_id"), "device"), _urn(F.col("record_id"), "report")
    url = lambda x: _urn(F.col("record_id"), F.when(x["part"] == 1, F.lit("finding")).otherwise(F.lit("measure")), x["key"])
    entry = lambda u, resource: F.struct(u.alias("fullUrl"), resource.alias("resource"))
    common = {"subject": _ref(subject), "effectiveDateTime": F.col("effective")}
    procedure = F.array(_concept((CATEGORY, "procedure", "Procedure")))

    def finding(x):
        f = x["finding"]
        own = F.struct(F.lit(system).alias("system"), x["key"].alias("code"), f["display"].alias("display"))
        other = F.struct(F.lit(ICD).alias("system"), f["target"].alias("code"), f["mapped"].alias("display"))
        note = F.when(F.size(f["leads"]) > 0, F.array(F.struct(F.concat(F.lit("Implicated leads: "), F.array_join(f["leads"], ", ")).alias("text"))))
        ext = lambda name, number, truth: F.struct(F.lit(f"{extension}:{name}").alias("url"), number.cast("double").alias("valueDecimal"), truth.cast("boolean").alias("valueBoolean"), F.lit(None).cast(_REF).alias("valueReference"))
        return _resource(
            resourceType=F.lit("Observation"), status=F.lit("final"), category=procedure, code=_concept((LOINC, "18844-1", "EKG impression")), **common,
            valueCodeableConcept=F.struct(F.when(f["target"].isNull(), F.array(own)).otherwise(F.array(own, other)).alias("coding"), f["display"].alias("text")),
            interpretation=F.array(_concept((READING, "A", "Abnormal"))), device=_ref(device), note=note,
            extension=F.array(ext("confidence", F.round(f["confidence"], 4), F.lit(None)), ext("needs-review", F.lit(None), f["needs_review"])),
        )

    def measure(x):
        field = lambda k: F.create_map(*[v for name, m in MEASURES.items() for v in (F.lit(name), F.lit(m[k]))])[F.substring(x["key"], 2, 99)]
        quantity = F.struct(x["value"].alias("value"), field(2).alias("unit"), F.lit(UNITS).alias("system"), field(3).alias("code"))
        return _resource(resourceType=F.lit("Observation"), status=F.lit("final"), category=procedure, code=_concept((LOINC, field(0), field(1))), **common, valueQuantity=quantity, device=_ref(device))

    found = F.filter("items", lambda x: x["part"] == 1)
    coded = F.filter(found, lambda x: x["finding"]["target"].isNotNull())
    of = lambda t: F.filter(coded, lambda x: x["finding"]["target"] == t)[0]["finding"]
    once = F.transform(F.array_distinct(F.transform(coded, lambda x: x["finding"]["target"])), lambda t: F.struct(of(t)["later"].alias("later"), t.alias("target"), of(t)["mapped"].alias("mapped")))
    codes = F.array_sort(once)
    concluded = F.transform(codes, lambda c: _concept((ICD, c["target"], c["mapped"])))
    status = F.when(F.col("review"), "preliminary").otherwise("final")
    made = F.array(F.struct(F.lit(f"{extension}:generated-by").alias("url"), F.lit(None).cast("double").alias("valueDecimal"), F.lit(None).cast("boolean").alias("valueBoolean"), _ref(device).alias("valueReference")))
    entries = F.concat(
        F.array(
            entry(device, _resource(resourceType=F.lit("Device"), status=F.lit("active"), deviceName=F.array(F.struct(F.lit("Interpretation software").alias("name"), F.lit("user-friendly-name").alias("type"))), version=F.array(F.struct(F.col("issuer_version").cast("string").alias("value"))))),
            entry(report, _resource(
                resourceType=F.lit("DiagnosticReport"), status=status, category=F.array(_concept((SECTION, "EC", "Electrocardiac"))), code=_concept((LOINC, "11524-6", "EKG study")), **common, issued=F.col("effective"),
                result=F.transform("items", lambda x: _ref(url(x))), conclusion=F.col("conclusion"), conclusionCode=F.when(F.size(codes) > 0, concluded), extension=made,
            )),
        ),
        F.when(F.col("subject").isNull(), F.array(entry(_urn(F.col("record_id"), "patient"), _resource(resourceType=F.lit("Patient"), identifier=F.array(F.struct(F.lit(f"{extension}:record").alias("system"), F.col("record_id").cast("string").alias("value"))))))).otherwise(F.array().cast(f"array<struct<fullUrl:string,resource:struct<{','.join(f'{k}:{t}' for k, t in _RESOURCE.items())}>>>")),
        F.transform(found, lambda x: entry(url(x), finding(x))),
        F.transform(F.filter("items", lambda x: x["part"] == 2), lambda x: entry(url(x), measure(x))),
    )
    whole = F.struct(F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type"), F.col("effective").alias("timestamp"), entries.alias("entry"))
    return g.select("record_id", status.alias("status"), F.to_json(whole).alias("bundle"))


def bundle_references(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``bundle_faults``: every reference (url, ref, kind, value) and every target (url, kind) of written bundles.

    ``kind`` is the resource that a reference should lead to, ``value`` the
    status of the resource that holds it. References to a subject outside the
    bundle are left out.
    """
    e = bundles.select(F.explode(F.from_json("bundle", BUNDLE)["entry"]).alias("e")).select(F.col("e.fullUrl").alias("url"), F.col("e.resource").alias("r"))
    to = lambda ref, kind: F.struct(ref.alias("ref"), F.lit(kind).alias("kind"))
    inner = F.when(F.col("r.subject.reference").startswith("urn:"), to(F.col("r.subject.reference"), "Patient"))
    many = F.transform(F.coalesce("r.result", F.array().cast(f"array<{_REF}>")), lambda x: to(x["reference"], "Observation"))
    device = F.when(F.col("r.device").isNotNull(), to(F.col("r.device.reference"), "Device"))
    refs = e.select("url", F.col("r.status").alias("value"), F.explode(F.concat(many, F.array_compact(F.array(inner, device)))).alias("to")).select("url", "to.ref", "to.kind", "value")
    return refs, e.select("url", F.col("r.resourceType").alias("kind"))


def _listed(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    return F.when(n <= 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(items, -1)))


def one_line_impressions(records: DataFrame, findings: DataFrame, vocabulary: DataFrame, *, max_chars: int = MAX_CHARS, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """record_id, impression: one sentence of at most ``max_chars`` characters, as far as shedding findings can make it.

    ``records``: record_id, rate (or null), review. ``findings``: record_id,
    code. ``vocabulary``: code, group, phrase, entity (the phrase without its
    place), localized, urgent, normal, benign. Unknown codes stand for
    themselves, in the last group. Findings go by urgency, consequence and
    code. Rhythm and rate come first, findings of one entity in several places
    become one; beyond ``max_findings`` they are counted. A sentence that is
    too long sheds findings from its end, most consequential last.
    """
    place = F.coalesce(*[F.when(F.col("group") == g, F.lit(k)) for k, g in enumerate(CONSEQUENCE)], F.lit(len(CONSEQUENCE)))
    known = findings.select("record_id", "code").distinct().join(vocabulary, "code", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    group = F.coalesce("group", F.lit("technical")).alias("group")
    rows = known.select("record_id", "code", group, F.coalesce("phrase", "code").alias("phrase"), F.coalesce("entity", "code").alias("entity"), *map(no, ("localized", "urgent", "normal", "benign")))
    item = F.struct((~F.col("urgent")).alias("calm"), place.alias("place"), "code", "group", "phrase", "entity", "localized", "urgent", "normal", "benign")
    g = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    df = records.select("record_id", "rate", F.coalesce("review", F.lit(False)).alias("review")).join(g, "record_id", "left")

    beats = F.filter("all", lambda f: f["group"].isin("rhythm", "pacing"))
    df = df.withColumn("lead", F.get(beats, F.lit(0))).withColumn("first", F.get(F.filter("all", lambda f: f["urgent"]), F.lit(0)))
    name = F.when(F.col("lead").isNotNull(), F.col("lead.phrase")).when(F.col("rate").isNotNull(), F.lit("Rhythm"))
    pace = F.when(F.col("rate").isNotNull(), F.concat(F.lit(" at "), F.bround("rate", 0).cast("long").cast("string"), F.lit(" bpm"))).otherwise("")
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))
    df = df.withColumn("rhythm", F.concat(name, pace)).withColumn("rhythm", F.coalesce(capital(F.col("rhythm")), F.lit("")))
    used = lambda f: F.coalesce(f["code"] == F.col("lead.code"), F.lit(False)) | F.coalesce(f["code"] == F.col("first.code"), F.lit(False)) | f["normal"] | (f["phrase"] == "")
    df = df.withColumn("left", F.filter("all", lambda f: ~used(f)))

    def clauses(entity):
        own = F.filter("left", lambda f: f["entity"] == entity)
        places = F.size(F.filter(own, lambda f: f["localized"]))
        return F.when(places >= 2, F.array(F.concat(F.lit("multi-territory "), entity))).otherwise(F.array_distinct(F.transform(own, lambda f: f["phrase"])))

    df = df.withColumn("rest", F.flatten(F.transform(F.array_distinct(F.transform("left", lambda f: f["entity"])), clauses)))
    df = df.withColumn("over", F.greatest(F.size("rest") - max_findings, F.lit(0))).withColumn("rest", F.slice("rest", 1, max_findings))
    urgent = F.when(F.col("first").isNotNull(), F.concat(F.lit("URGENT — "), F.col("first.phrase"), F.lit(": "))).otherwise("")
    tail = F.concat(F.when(F.col("review"), F.lit(f"; {REVIEW_CLAUSE}; {ATTRIBUTION}.")).otherwise(F.lit(f"; {ATTRIBUTION}.")))
    plus = lambda n: F.when(n > 0, F.concat(F.lit(", plus "), n.cast("string"), F.when(n > 1, F.lit(" further findings")).otherwise(F.lit(" further finding")))).otherwise("")
    has = F.col("rhythm") != ""
    plain = F.forall("all", lambda f: f["normal"] | f["benign"]) & F.exists("all", lambda f: f["normal"])
    sinus = F.lower("rhythm").contains("sinus rhythm")
    normal = F.when(~has, F.lit("Normal ECG")).when(sinus, F.concat("rhythm", F.lit(" — normal ECG"))).otherwise(F.concat("rhythm", F.lit(", otherwise normal ECG")))
    some = F.size("rest") > 0
    both = lambda rest: F.concat("rhythm", F.lit(" with "), _listed(rest))
    body = F.when(plain, normal).when(has & some, both(F.col("rest"))).when(has, F.col("rhythm")).when(some, capital(_listed(F.col("rest")))).otherwise("Abnormal ECG")
    full = F.concat(urgent, body, plus(F.col("over")), tail)

    def shed(k):
        """The sentence with the first k findings."""
        kept = F.slice("rest", F.lit(1), k)
        text = F.when(has & (k > 0), both(kept)).when(has, F.col("rhythm")).otherwise("Abnormal ECG")
        return F.concat(urgent, text, plus(F.col("over") + F.size("rest") - k), tail)

    shorter = F.when(some, F.transform(F.sequence(F.size("rest") - 1, F.lit(0)), shed)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array(full), shorter)
    fits = F.get(F.filter(texts, lambda t: F.length(t) <= max_chars), F.lit(0))
    text = F.when(F.coalesce(F.size("all"), F.lit(0)) == 0, F.lit(f"No diagnostic findings surfaced; {ATTRIBUTION}.")).otherwise(F.coalesce(fits, F.element_at(texts, -1)))
    return df.select("record_id", text.alias("impression"))


def training_examples(records: DataFrame, codes: DataFrame, vocabulary: DataFrame, ruled_out: str, *, seed: int = 0, threshold: float = 0.5, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(examples, rejects) of records.

    ``records``: record_id, age, sex, axis, rate, validated; ``codes``:
    record_id, code; ``vocabulary`` as for ``structured_findings``. An example
    has the known codes with a drawn confidence each (0.82 to 0.99, and 0.30
    to 0.49 for 15 %), the age (null from 200 on), M or F, the rate, the axis
    phrase of the four deviations, the threshold, and the rendered report.
    Draws hang on seed, record and code alone, so reruns and partitions do not
    matter. ``rejects`` has record_id and reason: not validated, or no known code.
    """
    u = lambda what: uniform(F.concat_ws(":", F.lit(f"{seed}:{what}"), F.col("record_id").cast("string"), "code"))
    low = u("low") < LOW_SHARE
    within = lambda r: F.lit(r[0]) + F.lit(r[1] - r[0]) * u("confidence")
    drawn = codes.select("record_id", "code").distinct().withColumn("confidence", F.round(F.when(low, within(LOW_RANGE)).otherwise(within(HIGH_RANGE)), 6))
    j = records.join(structured_findings(drawn, vocabulary), "record_id", "left")
    j = j.withColumn("reason", F.when(~F.coalesce("validated", F.lit(False)), "not validated").when(F.col("findings").isNull(), "no known code"))
    axis = F.create_map(*[x for code in AXES["en"] for x in (F.lit(code), F.lit(code))])[F.col("axis")]
    clean = j.where("reason is null").select(
        "record_id", F.when(F.col("age") < 200, F.col("age").cast("int")).alias("age"), F.when(F.col("sex") == 0, "M").when(F.col("sex") == 1, "F").alias("sex"),
        F.col("rate"), axis.alias("axis"), F.lit(float(threshold)).alias("threshold"), "findings",
    )
    report = render_reports(clean, ruled_out, lang, threshold, keep=True)
    return report, j.where("reason is not null").select("record_id", "reason")


def _two(x: Column) -> Column:
    """A number from 0 to below 100 with two decimals."""
    n = F.round(x * 100, 0).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def case_text(axes: dict[str, str]) -> Column:
    """What a generator sees of a case: patient, rate and axis, threshold, and a line for each finding with confidence and leads."""
    patient = F.concat_ws(" ", F.concat(F.col("age").cast("string"), F.lit("y")), "sex")
    phrase = F.create_map(*[F.lit(x) for kv in axes.items() for x in kv])[F.col("axis")]
    signal = F.concat_ws(" | ", F.concat(F.lit("rate "), F.bround("rate", 0).cast("long").cast("string"), F.lit(" bpm")), F.concat(F.lit("axis "), phrase))
    line = lambda f: F.concat(
        F.lit("- "), f["code"], F.coalesce(F.concat(F.lit(" ("), f["group"], F.lit(")")), F.lit("")), F.lit(": confidence="), F.coalesce(_two(f["confidence"]), F.lit("n/a")),
        F.lit(", leads="), F.coalesce(F.nullif(f["leads"], F.lit("")), F.lit("n/a")),
    )
    found = F.when(F.size("findings") > 0, F.transform("findings", line)).otherwise(F.array(F.lit("- (none surfaced)")))
    head = F.array_compact(F.array(F.when(patient != "", F.concat(F.lit("Patient: "), patient)), F.when(signal != "", signal), F.concat(F.lit("Review threshold: "), _two(F.col("threshold"))), F.lit("Detected findings:")))
    return F.array_join(F.concat(head, found), "\n")


def chat_rows(examples: DataFrame, system: str, lang: str = "en", rules: dict[str, str] | None = None) -> DataFrame:
    """record_id, system, prompt, completion from examples; ``context`` (null or empty: none) stands between the case and the request.

    The rules of ``system`` are the same in every language; ``rules[lang]`` is put after them.
    """
    context = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("\n\n"), "context")).otherwise("")
    prompt = F.concat(case_text(AXES["en"]), context, F.lit("\n\nWrite the report now."))
    return examples.select("record_id", F.lit(system + (rules or {}).get(lang, "")).alias("system"), prompt.alias("prompt"), F.col("report").alias("completion"))
