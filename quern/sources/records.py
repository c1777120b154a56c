"""Document sources: maintenance records, context lists and clinical sessions, as doc_id, text, metadata.

Files are read by Spark's readers, a row at a time; texts are put together
from columns. Each reader takes any path or glob that Spark can read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The fields of a maintenance record, and which of them are its metadata.
FIELDS = ("NO", "Customer", "Engineers", "Service Start", "Service End", "Description", "Action")
METADATA = ("NO", "Customer", "Engineers", "Service Start", "Service End")
MODES = ("natural_text", "markdown", "key_value_text", "unstructured_text")

#: The record's text by mode; {field} is replaced, and missing fields have the default after the bar.
TEMPLATES = {
    "natural_text": (
        "這是一筆關於 {Customer} 的維護紀錄。\n處理工程師為 {Engineers}\n進行時間為 {Service Start} 至 {Service End}。\n"
        "狀態描述 (Description): {Description}\n處置動作 (Action): {Action}"
    ),
    "markdown": (
        "# Maintenance Record (維護紀錄)\n\n## Metadata (Context Only)\n- **Record NO**: {NO|N/A}\n- **Customer**: {Customer|N/A}\n- **Engineers**: {Engineers|N/A}\n"
        "- **Service Time**: {Service Start|N/A} to {Service End|N/A}\n## Target Details (For Entity and Relation Extraction)\n"
        "### Description (狀態描述)\n{Description|無描述}\n\n### Action (處置動作)\n{Action|無動作}\n"
    ),
    "key_value_text": (
        "NO: {NO}\nCustomer: {Customer}\nEngineers: {Engineers}\nStart Time: {Service Start}\nEnd Time: {Service End}\nDescription: {Description}\nAction: {Action}"
    ),
    "unstructured_text": (
        "=== BACKGROUND CONTEXT (DO NOT EXTRACT ENTITIES FROM THIS SECTION) ===\nRecord NO: {NO}\nCustomer: {Customer}\nEngineer: {Engineers}\n"
        "======================================================================\n\n"
        "=== TARGET TEXT FOR EXTRACTION (ONLY EXTRACT ENTITIES AND RELATIONS FROM HERE) ===\nDescription: {Description}\nAction: {Action}\n"
        "=================================================================================="
    ),
}

#: A clinical session's text by mode.
SESSIONS = {
    "natural_text": (
        "患者病歷號 {case}（{age} 歲，血型 {blood}，HBV/HCV/HIV: {hbv}/{hcv}/{hiv}）\n透析日期：{date}\n--- 護理紀錄 ---\n{nurse}\n--- 醫囑 ---\n{orders}\n"
        "--- 評估計畫 ---\n{plan}\n--- 過濾器狀態 ---\n{fiber}\n"
    ),
    "markdown": (
        "# 透析紀錄（{date}）\n\n## 患者資訊\n- 病歷號: {case}\n- 年齡: {age} 歲\n- 血型: {blood}\n- HBV: {hbv}, HCV: {hcv}, HIV: {hiv}\n\n"
        "## 護理紀錄\n{nurse}\n\n## 醫囑\n{orders}\n\n## 評估計畫 (A+P)\n{plan}\n\n## 過濾器狀態\n{fiber}\n"
    ),
    "key_value_text": (
        "病歷號: {case}\n年齡: {age}\n血型: {blood}\nHBV/HCV/HIV: {hbv}/{hcv}/{hiv}\n透析日期: {date}\n護理紀錄:\n{nurse}\n醫囑:\n{orders}\n評估計畫:\n{plan}\n過濾器狀態:\n{fiber}\n"
    ),
    "unstructured_text": (
        "=== TARGET TEXT FOR EXTRACTION ===\n患者病歷號 {case}（{age} 歲，血型 {blood}，HBV/HCV/HIV: {hbv}/{hcv}/{hiv}）\n透析日期：{date}\n\n"
        "護理紀錄:\n{nurse}\n\n醫囑:\n{orders}\n\n評估計畫:\n{plan}\n\n過濾器狀態:\n{fiber}\n=================================="
    ),
}
NONE = "（無）"


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    return mode


def filled(template: str, fields: dict[str, Column]) -> Column:
    """`template` with its {field} or {field|default} places taken from columns; a missing field without default is an error."""
    parts: list[Column] = []
    for k, piece in enumerate(template.replace("{", "\0").replace("}", "\0").split("\0")):
        if k % 2 == 0:
            parts += [F.lit(piece)] if piece else []
            continue
        name, bar, default = piece.partition("|")
        value = fields[name].cast("string")
        missing = F.lit(default) if bar else F.raise_error(F.lit(f"a record without {name!r}"))
        parts.append(F.coalesce(value, missing))
    return F.concat(*parts)


def record_documents(records: DataFrame, mode: str = "natural_text") -> DataFrame:
    """Maintenance records (columns of FIELDS) as doc_id, text and metadata (a map of what is there)."""
    fields = {f: F.col(f"`{f}`") for f in FIELDS}
    return records.select(
        fields["NO"].cast("string").alias("doc_id"),
        filled(TEMPLATES[check_mode(mode)], fields).alias("text"),
        T.metadata_map({f: fields[f] for f in METADATA}).alias("metadata"),
    )


def read_records(spark: SparkSession, path: str, mode: str = "natural_text") -> DataFrame:
    """One JSON object a line; a broken line is an error."""
    schema = ", ".join(f"`{f}` string" for f in FIELDS)
    return record_documents(spark.read.schema(schema).option("mode", "FAILFAST").json(path), mode)


def read_contexts(spark: SparkSession, path: str, mode: str = "natural_text") -> DataFrame:
    """Files that hold one JSON list of texts each: doc_id (md5 of the trimmed text), text, metadata, pos.

    Anything else than a list of non-blank strings is an error.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("items"), F.col("_metadata.file_name").alias("file"))
    items = F.when(F.col("items").isNull(), F.raise_error(F.lit("not a JSON list of texts"))).otherwise(F.col("items"))
    rows = whole.select("file", F.posexplode(items).alias("pos", "raw"))
    text = F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", F.raise_error(F.lit("a blank text in the list"))).otherwise(F.trim("raw"))
    named = rows.select("file", "pos", text.alias("text")).withColumn("doc_id", F.md5("text"))
    # How a text is wrapped in each mode.
    wrap = {
        "natural_text": F.col("text"),
        "markdown": F.concat(F.lit("# UltraDomain Document\n\n- Domain: unknown\n- Doc ID: "), "doc_id", F.lit("\n\n"), "text"),
        "key_value_text": F.concat(F.lit("NO: "), "doc_id", F.lit("\nDomain: unknown\nContext:\n"), "text"),
        "unstructured_text": F.concat(F.lit("=== TARGET TEXT FOR EXTRACTION ===\n"), "text", F.lit("\n==================================")),
    }[check_mode(mode)]
    return named.select("doc_id", wrap.alias("text"), T.metadata_map({"NO": F.col("doc_id"), "source": F.col("file")}).alias("metadata"), "pos")


_CLINICAL = (
    "case_number string, age string, blood_type string, blood_rh string, hbv string, hcv string, hiv string, "
    "nurse_record array<array<string>>, `order` array<array<string>>, `a+p` array<array<string>>, fiber_list array<array<string>>"
)


def session_documents(patients: DataFrame, mode: str = "natural_text", data_type: str = "bio") -> DataFrame:
    """One document for each patient and date: doc_id (md5 of case and date), text, metadata.

    Notes belong to the date that they begin with; orders, plans and filter
    states to the date that they name. The metadata name the data type, and
    the source where `patients` has a column of that name.
    """
    listed = {n: F.coalesce(F.col(f"`{n}`"), F.array().cast("array<array<string>>")) for n in ("nurse_record", "order", "a+p", "fiber_list")}
    day = lambda items: F.transform(F.filter(items, lambda x: F.size(x) > 0), lambda x: x[0])
    notes = F.transform(day(listed["nurse_record"]), lambda t: F.split(F.trim(t), r"\s+")[0])
    dates = F.array_sort(F.array_distinct(F.concat(notes, *[day(listed[n]) for n in ("order", "a+p", "fiber_list")])))
    rows = patients.withColumn("date", F.explode(dates))
    date = F.col("date")

    def lines(items: Column, keep, show) -> Column:
        found = F.array_join(F.transform(F.filter(items, keep), show), "\n")
        return F.when(F.size(F.filter(items, keep)) > 0, found).otherwise(F.lit(NONE))

    clock = lambda t: F.when(t.contains(" "), F.regexp_extract(t, r"^[^ ]* ([\s\S]*)$", 1)).otherwise(t)
    rest = lambda x: F.array_join(F.filter(F.slice(x, F.lit(3), F.greatest(F.size(x) - 2, F.lit(0))), lambda y: F.coalesce(y, F.lit("")) != ""), " ")
    at = lambda x: x[0] == date
    states = lambda s: F.when(s.startswith("["), F.array_join(F.from_json(s, "array<string>"), ", ")).otherwise(s)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = {
        "case": blank("case_number"), "age": blank("age"), "blood": F.concat(blank("blood_type"), blank("blood_rh")),
        **{c: F.coalesce(F.col(c), F.lit("0")) for c in ("hbv", "hcv", "hiv")}, "date": date,
        "nurse": lines(listed["nurse_record"], lambda x: x[0].startswith(date) & (F.coalesce(F.try_element_at(x, F.lit(2)), F.lit("")) != ""), lambda x: F.concat(F.lit("["), clock(x[0]), F.lit("] "), x[1])),
        "orders": lines(listed["order"], lambda x: (F.size(x) >= 2) & at(x), lambda x: F.trim(F.concat(x[1], F.lit(" "), rest(x)))),
        "plan": lines(listed["a+p"], lambda x: (F.size(x) >= 2) & at(x), lambda x: x[1]),
        "fiber": lines(listed["fiber_list"], lambda x: (F.size(x) >= 2) & at(x), lambda x: states(x[1])),
    }
    return rows.select(
        F.md5(F.concat(blank("case_number"), date)).alias("doc_id"), filled(SESSIONS[check_mode(mode)], fields).alias("text"),
        T.metadata_map({
            "case_number": F.col("case_number"), "session_date": date, "age": F.col("age"), "blood_type": fields["blood"], **{c: fields[c] for c in ("hbv", "hcv", "hiv")},
            **({"source": F.col("source")} if "source" in patients.columns else {}), "data_type": F.lit(data_type),
        }).alias("metadata"),
    )


def read_sessions(spark: SparkSession, path: str, mode: str = "natural_text", data_type: str = "bio") -> DataFrame:
    """Clinical records, one JSON object a line (blank lines are skipped), as sessions; their source is the file's name."""
    patients = spark.read.schema(_CLINICAL).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_name").alias("source"))
    return session_documents(patients, mode, data_type)


def metadata_entities(docs: DataFrame, keys: tuple[str, ...] = ("Customer", "Engineers", "customer", "engineers", "entities")) -> DataFrame:
    """doc_id and entity, in order and each once: what documents' metadata (a map) name under `keys`; the id is NO, atom_id or id."""
    ident = F.coalesce(*[F.col("metadata")[k] for k in ("NO", "atom_id", "id")], F.col("doc_id"))
    found = F.array(*[F.col("metadata")[k] for k in keys])
    named = F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))
    return docs.select(ident.alias("doc_id"), F.posexplode(named).alias("pos", "entity"))


def metadata_triples(docs: DataFrame) -> DataFrame:
    """Subject, relation, object of records' metadata: the record belongs to its customer, its engineer handled it."""
    m = F.col("metadata")
    record = F.concat(F.lit("Record_"), F.coalesce(m["NO"], F.col("doc_id")))
    triples = F.array(
        F.struct(record.alias("subject"), F.lit("BELONGS_TO").alias("relation"), T.present(m["Customer"]).alias("object")),
        F.struct(T.present(m["Engineers"]).alias("subject"), F.lit("HANDLED").alias("relation"), record.alias("object")),
    )
    return docs.select(F.explode(triples).alias("t")).select("t.*").where("subject is not null and object is not null")


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines, UTF-8, in as many files as there are parts."""
    docs.write.mode("overwrite").json(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables one after the other, columns that some lack null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
