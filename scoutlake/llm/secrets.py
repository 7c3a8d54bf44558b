"""Secret scans with an incremental blob ledger.

A text is a blob named by its SHA-256. The ledger is a Parquet table of (blob, rules, spans): which rule versions have been
run on a blob, and which of them found what. A scan looks only at blobs for which the ledger lacks a current rule version, once
for each blob and with the lacking rules only, appends what it found, and joins what current versions found back to every row
(path, version of a document) that holds the blob. Appending is a Spark write, so a failed or repeated run leaves no half entry
and costs no wrong result. The ledger lies where the setting LEDGER says, in a folder that all executors share, and grows from
run to run; without the setting each run starts one of its own.

Defined results: a null text is empty and has no spans; copies share one entry; repeated rows are rows of their own; spans are
in code points, the end exclusive; other columns are kept by `redacted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

#: A private key from its BEGIN line through its END line; where that is missing, over the header and base64 lines that follow.
_PEM = (
    r"-----BEGIN (?P<label>[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----"
    r"(?:(?:[^-]|-(?!----BEGIN ))*?-----END (?P=label)-----"
    r"|(?:(?:[\s>]|\\[nr])+(?:(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash):[^\r\n\\]*|[A-Za-z0-9+/=]{20,}|[A-Za-z0-9+/]+={1,2})"
    r"|(?:\r?\n|\r|\\r\\n|\\[nr])[\x20\t>]*[A-Za-z0-9+/=]+[\x20\t]*(?=[\r\n]|\\[nr]|\Z))*)"
)
#: kind: version, words (lower-cased) of which a text must have one, pattern, least length of the value, the value's group.
RULES: dict[str, tuple[int, tuple[str, ...], str, int, int]] = {
    "assign": (1, ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": (1, ("akia",), r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (1, (), r"[0-9a-f]{16,}", 16, 0),
    "pem": (2, ("private key",), _PEM, 0, 0),
    "jwt": (1, ("eyj",), r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    "forge": (1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
}
BASE = ("assign", "access", "hex")
KINDS = list(RULES)
#: Blobs with findings (about 200 bytes each) that may be broadcast to mark documents.
FOUND_ROWS = 100_000
MARK = "[secret]"

#: The Spark setting with the ledger's path.
LEDGER = "spark.scoutlake.ledger"
_LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"


def rule_versions() -> list[str]:
    return [f"{kind}:{rule[0]}" for kind, rule in RULES.items()]


def _patterns(rules: dict) -> dict[str, tuple[tuple[str, ...], re.Pattern, int, int]]:
    return {f"{kind}:{v}": (words, re.compile(p), least, group) for kind, (v, words, p, least, group) in rules.items()}


def spans_in(text: str, rules: list[str], patterns: dict) -> list[dict]:
    """What some rules find in a text."""
    low = text.lower()
    found = []
    for rule in rules:
        words, pattern, least, group = patterns[rule]
        if words and not any(w in low for w in words):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append({"rule": rule, "start": m.start(), "end": m.end()})
    return found


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def scanned(docs: DataFrame, ledger: str, blob: str = "blob") -> DataFrame:
    """blob, spans for every blob of docs (columns blob, text), after scanning what the ledger lacks."""
    spark, versions, rules = docs.sparkSession, rule_versions(), dict(RULES)
    known = _ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("had"))
    lacking = F.array_except(F.array(*map(F.lit, versions)), F.coalesce("had", F.array().cast("array<string>")))
    rows = docs.select(F.col(blob).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    rows = rows.join(known, "blob", "left").withColumn("rules", lacking).filter(F.size("rules") > 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = _patterns(rules)
        for frame in frames:
            spans = [spans_in(t, list(r), patterns) for t, r in zip(frame["text"], frame["rules"], strict=True)]
            yield pd.DataFrame({"blob": frame["blob"], "rules": frame["rules"], "spans": spans})

    rows.select("blob", "rules", "text").mapInPandas(run, _LEDGER).write.mode("append").parquet(ledger)
    found = _ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    order = F.create_map(*(x for i, r in enumerate(versions) for x in (F.lit(r), F.lit(i))))
    current = F.filter("spans", lambda s: s["rule"].isin(versions))
    placed = F.transform(current, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["rule"]).alias("nth"), s["end"].alias("end"), F.split(s["rule"], ":")[0].alias("kind")))
    return found.select("blob", F.array_sort(placed).alias("spans"))


def ledger_path(spark: SparkSession) -> str:
    return spark.conf.get(LEDGER, None) or shared.new_path(spark, "ledger")


def with_blob(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def findings(docs: DataFrame, ledger: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """id_column, blob, spans (start, nth, end, kind; in order) for each row of docs."""
    rows = with_blob(docs.select(id_column, "text"))
    found = scanned(rows, ledger or ledger_path(docs.sparkSession)).filter(F.size("spans") > 0)
    found = shared.written(found, "found")
    rows = rows.drop("text")
    if found.count() <= FOUND_ROWS:
        rows = rows.join(F.broadcast(found), "blob", "left")
    else:
        held = rows.groupBy("blob").agg(F.count(F.lit(1)).alias("held"))
        rows = shared.spread_join(rows, shared.written(found.join(held, "blob"), "held"), "blob")
    none = F.array().cast("array<struct<start:int,nth:int,end:int,kind:string>>")
    return rows.select(id_column, "blob", F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """docs, with all their columns, in whose texts each stretch of found spans is MARK; n_chars, if there is one, follows."""
    rows = with_blob(docs.select("text"))
    found = scanned(rows, ledger or ledger_path(docs.sparkSession)).filter(F.size("spans") > 0)
    found = shared.written(found.select("blob", "spans"), "secrets")
    blob = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    marked = docs.join(shared.checked_broadcast(found, FOUND_ROWS), blob == found["blob"], "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))
    text = docs["text"]

    def step(done, s):
        clear = F.when(s["start"] >= done["end"], F.concat(F.substring(text, done["end"] + 1, s["start"] - done["end"]), F.lit(MARK))).otherwise("")
        return F.struct(F.concat(done["text"], clear).alias("text"), F.greatest(done["end"], s["end"]).alias("end"))

    clean = F.aggregate(found["spans"], start, step, lambda d: F.concat(d["text"], F.substring(text, d["end"] + 1, F.length(text))))
    clean = F.when(found["spans"].isNull(), text).otherwise(clean)
    columns = [clean.alias(c) if c == "text" else docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]
    out = marked.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
