"""Rule packs: the data model, the packaged catalogue, custom packs and how they merge."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.fixed_values import CUSTOM_RULE_DEFAULTS, LANGUAGE_KEYS, MATCH_TYPES
from scanloom.functions.dialect import is_live, lower_case, required_text, to_java
from scanloom.functions.text import one_json_value
from scanloom.sources.local import local_table

RULES_PATH_CONF = "spark.scanloom.rules.path"

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("multi_line_patterns", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("remediation", T.StringType()),
])
CATALOG_SCHEMA = T.StructType([T.StructField("rule_ord", T.IntegerType())] + RULE_SCHEMA.fields)


@dataclass(frozen=True)
class Pattern:
    idx: int
    text: str
    java: str
    folded: bool  # whether ``java`` is to run on lower-case text
    required: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Rule:
    ord: int
    id: str
    name: str
    category: str
    severity: str
    languages: tuple[str, ...]
    patterns: tuple[str, ...]
    multi_line_patterns: tuple[str, ...]
    description: str
    remediation: str
    ignore_case: bool = True
    single: tuple[Pattern, ...] = field(default=(), compare=False)
    multi: tuple[Pattern, ...] = field(default=(), compare=False)

    @staticmethod
    def of(ord: int, row: dict) -> "Rule":
        ignore_case = row.get("ignore_case", True)
        texts = {k: tuple(p for p in row.get(k) or () if p is not None)
                 for k in ("languages", "patterns", "multi_line_patterns")}

        def compiled(i, p, multi_line):
            lowered = lower_case(p) if ignore_case else None
            java = to_java(p, multi_line, ignore_case) if lowered is None else to_java(lowered, multi_line, False)
            return Pattern(i, p, java, lowered is not None, tuple(required_text(p)))

        def live(kind, multi_line):
            return tuple(compiled(i, p, multi_line) for i, p in enumerate(texts[kind]) if is_live(p))

        return Rule(
            ord, row["id"], row["name"], row["category"], row["severity"], **texts,
            description=row["description"], remediation=row["remediation"], ignore_case=ignore_case,
            single=live("patterns", False), multi=live("multi_line_patterns", True),
        )


def read_pack(name: str) -> dict:
    return json.loads(resources.files("scanloom.packs").joinpath(name).read_text(encoding="utf-8"))


@cache
def builtin_rules() -> tuple[Rule, ...]:
    return tuple(Rule.of(i, r) for i, r in enumerate(read_pack("owasp_rules.json")["rules"], 1))


@cache
def secret_rules() -> tuple[Rule, ...]:
    return tuple(Rule.of(i, r) for i, r in enumerate(read_pack("secret_rules.json")["rules"], 1))


def catalog_df(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [{"rule_ord": r.ord} | {c: getattr(r, c) for c in RULE_SCHEMA.fieldNames()} for r in rules]
    return local_table(spark, rows, CATALOG_SCHEMA)


def patterns_df(spark: SparkSession, passes: list[tuple[int, str, Sequence[Rule]]]) -> DataFrame:
    """One row per pattern, with everything a finding repeats from its rule.

    ``passes`` names for every pass its number, the kind of patterns it runs ("single" or "multi") and its rules.
    """
    rows = [
        {"pass_ord": pass_ord, "rule_ord": r.ord, "pattern_idx": p.idx, "rule_id": r.id, "rule_name": r.name,
         "category": r.category, "severity": r.severity, "description": r.description,
         "remediation": r.remediation, "matched_pattern": p.text, "match_type": MATCH_TYPES[pass_ord]}
        for pass_ord, kind, rules in passes
        for r in rules
        for p in getattr(r, kind)
    ]
    return local_table(
        spark, rows,
        "pass_ord int, rule_ord int, pattern_idx int, rule_id string, rule_name string, category string, "
        "severity string, description string, remediation string, matched_pattern string, match_type string",
    )


def language_rules(rules: Sequence[Rule], language: str) -> list[Rule]:
    """Rules filed under any name of the language; names are compared exactly."""
    keys = set(LANGUAGE_KEYS.get(language, ()))
    return [r for r in rules if keys & set(r.languages)]


# ---- custom packs ---------------------------------------------------------------------------------------

def normalize_rules(raw: DataFrame) -> DataFrame:
    """Fill the defaults of custom rules (``raw`` has RULE_SCHEMA columns); other columns pass through."""
    level = F.lower("severity")
    known = F.when(level.isin("low", "medium", "high", "critical"), F.initcap(level))
    lists = ("languages", "patterns", "multi_line_patterns")
    return raw.withColumns(
        {c: F.coalesce(F.col(c), F.lit(CUSTOM_RULE_DEFAULTS[c])) for c in CUSTOM_RULE_DEFAULTS if c != "severity"}
        | {"severity": F.coalesce(known, F.lit(CUSTOM_RULE_DEFAULTS["severity"]))}
        | {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists}
    )


def parse_rule_packs(packs: DataFrame, json_col: str = "json") -> DataFrame:
    """Rules inside JSON texts, one row per rule with its position; other columns of ``packs`` pass through."""
    keep = [c for c in packs.columns if c != json_col]
    pack = one_json_value(F.col(json_col), f"rules: array<{RULE_SCHEMA.simpleString()}>", "FAILFAST")
    checked = F.when(pack.isNotNull(), pack).otherwise(F.raise_error(F.lit("a rule pack must be one JSON object")))
    exploded = packs.select(*keep, F.posexplode(checked["rules"]).alias("position", "r"))
    return normalize_rules(exploded.select(*keep, "position", "r.*"))


def read_rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """Custom rules from a JSON file: a missing file has no rules, a broken one is an error."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    storage = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not storage.exists(jvm_path):
        return spark.createDataFrame([], T.StructType([T.StructField("position", T.IntegerType())] + RULE_SCHEMA.fields))
    if storage.getFileStatus(jvm_path).isFile() and storage.getFileStatus(jvm_path).getLen() == 0:
        raise ValueError(f"rule pack {path} is empty")  # which Spark would read as no text at all
    return parse_rule_packs(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def merge_rules(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """A custom rule replaces the built-in of the same id in place, the last one winning; the rest are appended.

    ``builtin`` has CATALOG_SCHEMA; ``custom`` has ``position`` (unique) and the rule columns.
    """
    cols = RULE_SCHEMA.fieldNames()
    ids = F.broadcast(builtin.select("id"))
    # At most one row per built-in rule, however many custom rules there are.
    last = custom.join(ids, "id", "left_semi").groupBy("id").agg(
        F.max_by(F.struct("position", *cols), "position").alias("c"))
    kept = builtin.join(F.broadcast(last), "id", "left").select(
        "rule_ord",
        F.lit(0).alias("block"),
        F.lit(0).cast("long").alias("position"),
        *[F.when(F.col("c").isNotNull(), F.col(f"c.{c}")).otherwise(F.col(c)).alias(c) for c in cols],
    )
    added = custom.join(ids, "id", "left_anti").select(
        F.lit(None).cast("int").alias("rule_ord"), F.lit(1).alias("block"),
        F.col("position").cast("long").alias("position"), *cols)
    return kept.unionByName(added)


def collect_rules(spark: SparkSession, merged: DataFrame) -> list[Rule]:
    """Bring a merged pack to the driver, where what its patterns require is worked out. A pack is settings, not data."""
    rows = merged.orderBy("block", "rule_ord", "position").collect()
    rules = [Rule.of(i, row.asDict()) for i, row in enumerate(rows, 1)]
    # Python accepts these patterns; let Java reject what it cannot run here rather than inside a task. They are rows, not
    # parts of a plan, which would grow with the pack.
    probes = [{"java": p.java} for r in rules for p in (*r.single, *r.multi)]
    local_table(spark, probes, "java string").agg(F.count_if(F.rlike(F.lit(""), F.col("java")))).collect()
    return rules


def load_rules(spark: SparkSession, custom_path: str | None = None) -> Sequence[Rule]:
    """The built-in catalogue, merged with the custom pack at ``custom_path`` or ``spark.scanloom.rules.path``."""
    path = custom_path or spark.conf.get(RULES_PATH_CONF, None)
    builtin = builtin_rules()
    if not path:
        return builtin
    return collect_rules(spark, merge_rules(catalog_df(spark, builtin), read_rule_pack(spark, path)))
