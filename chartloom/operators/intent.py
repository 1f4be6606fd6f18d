"""Question routing, compact panel lines and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.config import SETTINGS
from chartloom.functions.text import any_contains, count_contains, estimate_tokens
from chartloom.operators import chart
from chartloom.operators.batching import batches
from chartloom.operators.formatters import DATE, TIME, appointment_line, medication_line, patient_summary, record_line
from chartloom.operators.labels import age, full_name

#: Intents in order of preference with the substrings that count for them.
INTENTS = (
    ("demographics", ("age", "old", "young", "birth", "gender", "sex", "male", "female", "mrn", "blood type", "demographic")),
    ("medications", ("medication", "medicine", "drug", "prescri", "dose", "biologic", "topical", "steroid", "methotrexate", "refill", "pharmacy")),
    ("conditions", ("diagnosis", "condition", "disease", "psoriasis", "eczema", "dermatitis", "melanoma", "acne", "rash", "lesion", "biopsy")),
    ("scheduling", ("appointment", "schedule", "visit", "upcoming", "follow-up", "next visit", "today", "tomorrow", "when")),
    ("riskFactors", ("allergy", "allergic", "risk", "smok", "flag", "contraindic")),
)
EVERYTHING = "fullClinical"
#: Fallback routes in order.
PATIENT_ROUTES = (("medications", ("medication", "prescription", "rx", "refill")), ("appointments", ("appointment", "follow-up", "schedule", "next visit")), ("profile", ("allerg", "smok", "pharmacy", "mrn", "risk")))
PANEL_ROUTES = (("schedule", ("schedule", "today", "agenda", "who")), ("medications", ("medication", "rx", "prescri", "drug", "taking")), ("risk", ("risk", "allerg", "flag", "smok")))


def classify(text: Column) -> Column:
    """The intent with most keyword substrings, the first on ties; none: everything (RTR-01)."""
    low = F.lower(text)
    scores = [F.struct(count_contains(low, words).alias("n"), F.lit(-i).alias("p"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(INTENTS)]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["intent"]).otherwise(F.lit(EVERYTHING))


def route(text: Column, routes, default: str) -> Column:
    low = F.lower(text)
    out = F.lit(default)
    for name, words in reversed(routes):
        out = F.when(any_contains(low, words), F.lit(name)).otherwise(out)
    return out


def _or(value: Column, text: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.lit(text))


def compact_lines(intent: str, patients: DataFrame, records: DataFrame, medications: DataFrame, appointments: DataFrame, as_of: str) -> DataFrame:
    """(patient_id, line): one line a patient with the fields that the intent needs (RTR-02)."""
    name, years = full_name(), age(F.col("date_of_birth"), F.lit(as_of).cast("timestamp"))
    if intent == "demographics":
        blood = F.col("blood_type") if "blood_type" in patients.columns else F.lit(None).cast("string")
        return patients.select("patient_id", F.concat(name, F.lit(" | "), years, F.lit("y "), F.col("gender"), F.lit(" | MRN: "), F.left("medical_record_number", F.lit(8)), F.lit(" | Blood: "), F.coalesce(blood, F.lit("—"))).alias("line"))
    if intent == "medications":
        active = medications.where(chart.is_active(F.col("status")))
        text = F.concat(F.col("medication_name"), F.lit(" "), F.coalesce("dose", F.lit("")))
        m = active.groupBy("patient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rx_id", text.alias("t")))), lambda x: x["t"]), "; ").alias("m"))
        return patients.join(m, "patient_id", "left").select("patient_id", F.concat(name, F.lit(" | Meds: "), F.left(_or(F.col("m"), "none"), F.lit(200))).alias("line"))
    if intent == "conditions":
        c = records.groupBy("patient_id").agg(F.array_join(F.array_sort(F.collect_set("condition_name")), "; ").alias("c"))
        return patients.join(c, "patient_id", "left").select("patient_id", F.concat(name, F.lit(" | Dx: "), F.left(_or(F.col("c"), "none"), F.lit(200))).alias("line"))
    if intent == "scheduling":
        one = F.concat(F.date_format("scheduled_time", TIME), F.lit(": "), F.col("reason_for_visit"))
        w = Window.partitionBy("patient_id").orderBy("scheduled_time", "appointment_id")
        first = appointments.withColumn("__n", F.row_number().over(w)).where("__n <= 2")
        a = first.groupBy("patient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", one.alias("t")))), lambda x: x["t"]), "; ").alias("a"))
        return patients.join(a, "patient_id", "left").select("patient_id", F.concat(name, F.lit(" | Appts: "), _or(F.col("a"), "none scheduled")).alias("line"))
    if intent == "riskFactors":
        lists = lambda c: _or(F.array_join(c, ", "), "none")
        return patients.select("patient_id", F.concat(name, F.lit(" | Allergies: "), lists("allergies"), F.lit(" | Risks: "), lists("risk_flags"), F.lit(" | Smoker: "), F.when(F.col("is_smoker"), "yes").otherwise("no")).alias("line"))
    top = records.groupBy("patient_id").agg(F.max_by("condition_name", F.struct("date_recorded", "record_id")).alias("dx"))
    meds = medications.where(chart.is_active(F.col("status"))).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    first = chart.next_appointment(appointments, None).select("patient_id", F.date_format("scheduled_time", TIME).alias("next"))
    joined = patients.join(top, "patient_id", "left").join(meds, "patient_id", "left").join(first, "patient_id", "left")
    allergies = _or(F.array_join(F.slice("allergies", 1, 3), ","), "none")
    return joined.select(
        "patient_id",
        F.concat(name, F.lit(" | "), years, F.lit("y "), F.col("gender"), F.lit(" | Dx: "), F.coalesce("dx", F.lit("—")), F.lit(" | "), F.coalesce("n", F.lit(0)), F.lit(" meds | Allg: "), allergies, F.lit(" | Next: "), F.coalesce("next", F.lit("—"))).alias("line"),
    )


def model_for(prompt: Column, large_available: Column | None = None, bound: int = SETTINGS.large_prompt_tokens) -> Column:
    """Which model a prompt goes to: the large one beyond the bound where it is available, else the local one (RTR-09)."""
    large = estimate_tokens(prompt) > bound
    return F.when(large if large_available is None else large & large_available, "large").otherwise("local")


def available_tokens(system: Column, question: Column, context: Column, window: int = SETTINGS.window_tokens) -> Column:
    """Tokens left for panel lines (RTR-04)."""
    s = SETTINGS
    raw = window - estimate_tokens(system) - estimate_tokens(question) - F.coalesce(estimate_tokens(F.left(context, F.lit(1200))), F.lit(0)) - s.panel_reserve
    return F.greatest(F.lit(0), F.floor(raw * F.lit(s.panel_safety)))


def batch_lines(lines: DataFrame, chars: int, group: str | None = None, order: str = "patient_id", line: str = "line") -> DataFrame:
    """Lines in greedy batches of at most so many characters; a longer line is a batch of its own (RTR-05).

    One group is one prompt's worth of panel; groups are packed independently,
    and the lines of a long one in parts.
    """
    key = [group] if group else []
    placed = batches(lines.select(*key, order, line), F.length(line) + 1, chars, group, order, line)
    return placed.select(*key, "batch", order, line)


def panel_overview(patients: DataFrame, records: DataFrame, medications: DataFrame, appointments: DataFrame, as_of: str, k: int = 16) -> DataFrame:
    """Counts and next appointment of the first patients by name (RTR-08)."""
    totals = chart.panel_totals(patients, records, medications, appointments)
    nxt = chart.next_appointment(appointments, as_of, inclusive=False).select("patient_id", "reason_for_visit")
    few = patients.orderBy("last_name", "patient_id").limit(k).select("patient_id", full_name().alias("name"))
    joined = few.join(totals, "patient_id").join(nxt, "patient_id", "left")
    text = F.concat(F.col("name"), F.lit(" — "), F.col("records"), F.lit(" records, "), F.col("medications"), F.lit(" meds"), F.coalesce(F.concat(F.lit(", next: "), F.col("reason_for_visit")), F.lit("")))
    return joined.select("patient_id", text.alias("line"))


def answer_patient(query: str, patient_id: str, patients: DataFrame, records: DataFrame, medications: DataFrame, appointments: DataFrame, as_of: str) -> DataFrame:
    """Lines that answer a question about one patient without a model (RTR-06): position, line."""
    spark = patients.sparkSession
    kind = spark.range(1).select(route(F.lit(query), PATIENT_ROUTES, "history")).first()[0]
    mine = lambda df: df.where(F.col("patient_id") == patient_id)

    def lines(df, text, *order):
        return df.select(F.row_number().over(Window.orderBy(*order)).alias("position"), text.alias("line"))  # one patient's rows

    if kind == "medications":
        return lines(mine(medications), medication_line(medications.columns), F.desc("written_date"), "rx_id")
    if kind == "appointments":
        return lines(mine(appointments), appointment_line(appointments.columns), "scheduled_time", "appointment_id")
    if kind == "profile":
        return mine(patients).select(F.lit(1).alias("position"), patient_summary(patients.columns, F.lit(as_of).cast("timestamp")).alias("line"))
    own = mine(records)
    found = chart.token_search(own, query)
    text = record_line(records.columns)
    if found.isEmpty():
        return lines(own, text, F.desc("date_recorded"), "record_id").where("position <= 5")
    return lines(found, text, F.desc("date_recorded"), "record_id")


def answer_panel(query: str, patients: DataFrame, records: DataFrame, medications: DataFrame, appointments: DataFrame, as_of: str) -> DataFrame:
    """Lines that answer a question about all patients without a model (RTR-07)."""
    spark = patients.sparkSession
    kind = spark.range(1).select(route(F.lit(query), PANEL_ROUTES, "conditions")).first()[0]
    named = lambda df: df.join(patients.select("patient_id", full_name().alias("__name")), "patient_id")
    if kind == "schedule":
        day = named(appointments.where(chart.on_day(F.col("scheduled_time"), as_of)))
        text = F.concat(F.col("__name"), F.lit(" — "), F.date_format("scheduled_time", "h:mm a"), F.lit(": "), F.col("reason_for_visit"), F.lit(" ["), F.col("status"), F.lit("]"))
        return day.orderBy("scheduled_time", "appointment_id").select("patient_id", text.alias("line"))
    if kind == "medications":
        return named(medications).select("patient_id", F.concat(F.lit("["), F.col("__name"), F.lit("] "), F.col("medication_name"), F.lit(" | Status: "), F.coalesce("status", F.lit("Active"))).alias("line"))
    if kind == "risk":
        return chart.risk_entries(patients)
    found = named(chart.token_search(records, query, ("condition_name", "cc_hpi", "impressions_and_plan")))
    text = F.concat(F.lit("["), F.col("__name"), F.lit("] "), F.date_format("date_recorded", DATE), F.lit(": "), F.col("condition_name"), F.lit(" — "), F.col("status"))
    best = found.orderBy(F.desc("date_recorded"), "record_id").limit(10).select("patient_id", text.alias("line"))
    return panel_overview(patients, records, medications, appointments, as_of) if best.isEmpty() else best
