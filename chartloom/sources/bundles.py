"""Landed JSON: resource bundles, evaluation cases, tokens and capability statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.schemas import DDL

_CODED = "struct<coding:array<struct<system:string,code:string,display:string>>,text:string>"
RESOURCES = {
    "Patient": "struct<id:string,identifier:array<struct<system:string,value:string>>,name:array<struct<family:string,given:array<string>>>,gender:string,birthDate:string,"
    "contact:array<struct<name:struct<family:string,given:array<string>>,telecom:array<struct<system:string,value:string>>>>>",
    "Condition": f"struct<id:string,code:{_CODED},clinicalStatus:{_CODED},recordedDate:string,onsetDateTime:string>",
    "MedicationRequest": f"struct<id:string,medicationCodeableConcept:{_CODED},authoredOn:string,requester:struct<display:string>,dosageInstruction:array<struct<text:string,route:{_CODED}>>,status:string,dispenseRequest:struct<numberOfRepeatsAllowed:int>>",
    "Appointment": "struct<id:string,description:string,start:string,status:string,participant:array<struct<actor:struct<display:string>>>>",
    "AllergyIntolerance": f"struct<id:string,code:{_CODED}>",
}


def unwrap(raw: DataFrame, resource: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(resources in bundle order, rows that are no JSON) of texts that hold one bundle each (SRC-11)."""
    kind = f"struct<entry:array<struct<resource:{RESOURCES[resource]}>>>"
    parsed = raw.withColumn("__b", F.from_json(column, kind))
    entries = parsed.select(*[c for c in raw.columns if c != column], F.posexplode("__b.entry").alias("position", "__e"))
    good = entries.where(F.col("__e.resource").isNotNull()).select(*[c for c in entries.columns if c != "__e"], F.col("__e.resource.*"))
    bad = raw.where(F.col(column).isNotNull() & F.try_parse_json(column).isNull())
    return good, bad


def read_bundles(spark: SparkSession, path: str, resource: str) -> tuple[DataFrame, list[str]]:
    """Landed files, one bundle each; a missing or unreadable type is a warning and an empty frame (SRC-10)."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # a path that is not there
        return spark.createDataFrame([], "position int").join(spark.createDataFrame([], f"r {RESOURCES[resource]}"), how="cross").select("position", "r.*"), [f"{resource}: {type(e).__name__}"]
    good, bad = unwrap(raw, resource)
    n = bad.count()
    return good, [f"{resource}: {n} unreadable"] * bool(n)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Evaluation cases of a JSON-lines file and how many bad lines were dropped; blank and // lines are skipped (SRC-08, SRC-09)."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("//"))
    parsed = lines.select(F.from_json("line", ", ".join(DDL["eval_case"].split(", "))).alias("c")).select("c.*")
    good = parsed.where(F.col("id").isNotNull() & F.col("query").isNotNull())
    return good, lines.count() - good.count()


def jwt_payload(token: Column, ddl: str) -> Column:
    """The decoded payload of a JSON web token (SRC-14)."""
    body = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(body, F.length(body) + F.pmod(-F.length(body), F.lit(4)), F.lit("="))
    return F.from_json(F.decode(F.unbase64(padded), "UTF-8"), ddl)


def security_labels(statement: Column) -> Column:
    """Distinct labels of a capability statement's security services, in order (SRC-15)."""
    kind = f"struct<rest:array<struct<security:struct<service:array<{_CODED}>>>>>"
    services = F.flatten(F.transform(F.from_json(statement, kind)["rest"], lambda r: F.coalesce(r["security"]["service"], F.array().cast(f"array<{_CODED}>"))))
    codes = lambda s: F.transform(F.coalesce(s["coding"], F.array().cast("array<struct<system:string,code:string,display:string>>")), lambda c: F.coalesce(c["display"], c["code"]))
    labels = F.flatten(F.transform(services, lambda s: F.when(s["text"].isNotNull(), F.array(s["text"])).otherwise(codes(s))))
    return F.array_distinct(F.array_compact(labels))
