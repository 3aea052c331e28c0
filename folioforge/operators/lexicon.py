"""Constraint taxonomy, plausibility bounds, equipment profiles, and rule classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The constraint types (id, label, category, English and Chinese keywords).
TAXONOMY: list[tuple[int, str, str, list[str], list[str]]] = [
    (1, "Accessibility", "qualitative", ["accessibility", "reach", "clearance", "access", "passage"], ["可达", "触及", "通道", "间隙", "伸入", "接近", "够到"]),
    (2, "Interchangeability", "qualitative", ["interchangeability", "standardization", "standard parts", "interface"], ["互换", "标准化", "标准件", "接口统一", "通用化"]),
    (3, "Error-proofing", "qualitative", ["error-proofing", "fool-proof", "keying", "marking", "coding", "labeling"], ["防差错", "防误插", "防误装", "识别标志", "色标", "标识", "编码"]),
    (4, "Maintenance Safety", "qualitative", ["maintenance safety", "warning", "protection", "interlock", "hazard"], ["维修安全", "警示", "防护", "联锁", "高温", "高压", "电击", "辐射"]),
    (5, "Diagnostics", "qualitative", ["diagnostics", "BIT", "self-test", "fault detection", "fault isolation", "test point"], ["检测", "诊断", "BIT", "自检", "故障检测", "故障隔离", "测试点"]),
    (6, "Ergonomics", "qualitative", ["ergonomics", "human factors", "operating force", "workspace", "LRU weight"], ["人素", "人机工效", "操作空间", "操作力", "操作角度", "人体工程", "LRU重量"]),
    (7, "Repairability", "qualitative", ["repairability", "repairable", "repair"], ["可修复", "修复性", "可修", "修理", "复原"]),
    (8, "Reduced Maintenance", "qualitative", ["reduced maintenance", "maintenance-free", "self-lubricating"], ["减少维修", "免维护", "免维修", "自动润滑", "免调校"]),
    (9, "Reduced Skill", "qualitative", ["reduced skill", "skill level", "no special tools", "simplified"], ["降低技能", "技能要求", "无需专用工具", "拆装步骤", "简化操作"]),
    (10, "Time Parameters", "quantitative", ["MTTR", "mean time to repair", "repair time", "Mmax", "MMH/OH"], ["MTTR", "平均修复时间", "最大修复时间", "Mmax", "MMH/OH", "维修工时"]),
    (11, "Diagnostic Parameters", "quantitative", ["FDR", "FIR", "FAR", "fault detection rate", "fault isolation rate", "false alarm rate"], ["FDR", "FIR", "FAR", "故障检测率", "故障隔离率", "虚警率"]),
    (12, "Preventive Maintenance", "quantitative", ["preventive maintenance", "scheduled maintenance", "maintenance ratio"], ["预防维修", "预防性维修", "维修工时比", "定期维护"]),
]

#: Plausibility bounds (parameter, unit, lower, upper, constraint type).
BOUNDS: list[tuple[str, str, float, float, int]] = [
    ("accessibility_gap", "mm", 30.0, 500.0, 1),
    ("maintenance_passage_width", "mm", 400.0, 1500.0, 1),
    ("MTTR", "h", 0.1, 48.0, 10),
    ("MTBF", "h", 100.0, 100000.0, 10),
    ("manual_operating_force", "N", 5.0, 200.0, 6),
    ("LRU_weight", "kg", 0.1, 200.0, 6),
    ("FDR", "%", 50.0, 100.0, 11),
    ("FIR", "%", 50.0, 100.0, 11),
    ("FAR", "%", 0.0, 20.0, 11),
    ("operating_angle", "°", 0.0, 180.0, 6),
    ("disassembly_steps", "steps", 1.0, 50.0, 9),
]

#: Equipment profiles (name, metrics, emphasized type ids, own bounds).
PROFILES: dict[str, tuple[str, dict[str, float], list[int], dict[str, tuple[float, float]]]] = {
    "aircraft_engine": ("Aircraft Engine", {"MTTR": 1.0, "MTBF": 5000.0, "FDR": 98.0, "FIR": 90.0}, [1, 6, 9], {"accessibility_gap": (30.0, 250.0), "manual_operating_force": (5.0, 150.0), "LRU_weight": (0.1, 20.0)}),
    "naval_power": ("Naval Power System", {"MTTR": 4.0, "MTBF": 3000.0, "FDR": 95.0, "FIR": 85.0}, [1, 4, 5], {"accessibility_gap": (50.0, 500.0), "manual_operating_force": (5.0, 200.0), "LRU_weight": (0.1, 100.0)}),
    "armored_vehicle": ("Armored Vehicle", {"MTTR": 2.0, "MTBF": 2000.0, "FDR": 95.0, "FIR": 90.0}, [1, 3, 9], {"accessibility_gap": (40.0, 400.0), "manual_operating_force": (5.0, 180.0), "LRU_weight": (0.1, 50.0)}),
}

#: Words that tell a chunk's semantic type; the last list is case-sensitive.
PROCEDURE_WORDS = ["procedure", "step", "operation", "disassembly", "installation", "replacement"]
GUIDELINE_WORDS = ["design guideline", "design requirement", "guideline", "requirement", "shall", "should"]
CONSTRAINT_WORDS = ["≥", "≤", "≮", "≯", "%", "mm", "kg", "N", "h", "metric", "parameter", "threshold"]

#: Unit spellings, the family each unit belongs to and its factor to the family's base.
UNIT_FACTORS: dict[str, tuple[str, float]] = {
    "in": ("length", 1.0), "inch": ("length", 1.0), "inches": ("length", 1.0), "ft": ("length", 12.0), "feet": ("length", 12.0),
    "mm": ("length", 1 / 25.4), "cm": ("length", 1 / 2.54), "m": ("length", 1000 / 25.4),
    "min": ("time", 1.0), "minutes": ("time", 1.0), "h": ("time", 60.0), "hours": ("time", 60.0), "s": ("time", 1 / 60),
    "lb": ("mass", 1.0), "pounds": ("mass", 1.0), "kg": ("mass", 2.20462),
    "%": ("percent", 1.0), "deg": ("angle", 1.0), "°": ("angle", 1.0), "v": ("voltage", 1.0), "psi": ("pressure", 1.0),
}


def taxonomy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, label, c, en, zh) for i, label, c, en, zh in TAXONOMY], "id int, label string, category string, keywords array<string>, keywords_zh array<string>")


def bounds_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows or BOUNDS)], "ord int, parameter string, unit string, lower double, upper double, type_id int")


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def classify(text: Column, lexicon: dict[str, list[str]] | None = None, bilingual: bool = False, whole_words: bool = False) -> Column:
    """array<string>: the labels of which some keyword occurs, in the lexicon's order.

    Matching is by case-blind substring, so "bit" is found in "habit"; ``whole_words``
    asks for word borders.  ``bilingual`` adds the Chinese keywords of the taxonomy.
    """
    rules = lexicon or {label: en + (zh if bilingual else []) for _, label, _, en, zh in TAXONOMY}
    low = F.lower(text)
    if whole_words:
        from folioforge.functions.text import _quoted

        hit = lambda ws: F.rlike(low, F.lit("|".join(rf"(?<![a-z0-9]){_quoted(w.lower())}(?![a-z0-9])" for w in ws)))
    else:
        hit = lambda ws: has_any(low, [w.lower() for w in ws])
    return F.array_compact(F.array(*[F.when(hit(ws), F.lit(label)) for label, ws in rules.items()]))


def semantic_type(text: Column) -> Column:
    low = F.lower(text)
    count = lambda t, ws: sum((F.contains(t, F.lit(w)).cast("int") for w in ws), F.lit(0))
    procedure, guideline, constraint = count(low, PROCEDURE_WORDS), count(low, GUIDELINE_WORDS), count(text, CONSTRAINT_WORDS)
    return F.when(constraint >= 2, "constraint_specification").when(procedure > guideline, "maintenance_procedure").otherwise("design_guideline")


def hits(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def max_count_class(text: Column, lexicon: dict[str, list[str]], unknown: str = "Unknown") -> Column:
    """struct<label, score>: the label with most keywords found, the earlier one on ties."""
    scored = F.array(*[F.struct(hits(text, ws).alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label")) for i, (label, ws) in enumerate(lexicon.items())])
    best = F.array_max(scored)
    return F.struct(F.when(best["score"] > 0, best["label"]).otherwise(F.lit(unknown)).alias("label"), best["score"].alias("score"))


def weighted_class(text: Column, category: Column, custom: dict[str, list[str]], taxonomy: dict[str, list[str]], prefixes: dict[str, str], most: int = 4) -> Column:
    """struct<label, method, candidates>: +1 per custom keyword, +2 if the taxonomy matches.

    Ties keep the order custom first, then taxonomy.  Without a score the category's
    prefix decides; else the row is unmapped.
    """
    names = list(dict.fromkeys([*custom, *taxonomy]))
    score = lambda n: hits(text, custom.get(n, [])) + 2 * has_any(F.lower(text), [w.lower() for w in taxonomy.get(n, [])]).cast("int")
    rows = F.array(*[F.struct((-score(n)).alias("minus"), F.lit(i).alias("place"), F.lit(n).alias("label")) for i, n in enumerate(names)])
    ranked = F.transform(F.filter(F.array_sort(rows), lambda r: r["minus"] < 0), lambda r: r["label"])
    by_prefix = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, label in prefixes.items():
        by_prefix = by_prefix.when(F.startswith(category, F.lit(prefix)), F.lit(label))
    label = F.coalesce(F.get(ranked, F.lit(0)), by_prefix)
    method = F.when(F.size(ranked) > 0, "keyword").when(by_prefix.isNotNull(), "category_prefix").otherwise("unmapped")
    return F.struct(label.alias("label"), method.alias("method"), F.slice(ranked, 1, most).alias("candidates"))


def tiered_class(title: Column, prefix: Column, exact: dict[str, str], prefixes: dict[str, str] | None = None, least: int = 15) -> Column:
    """Exact title, then prefix, then the first key of which ``least`` characters stand in the title."""
    tier = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in exact.items():
        tier = tier.when(F.lower(title) == F.lit(k.lower()), F.lit(v))
    for k, v in (prefixes or {}).items():
        tier = tier.when(prefix == F.lit(k), F.lit(v))
    for k, v in exact.items():
        if len(k) > 5:
            tier = tier.when(F.contains(F.lower(title), F.lit(k.lower()[:least])), F.lit(v))
    return tier


def equipment_types(text: Column, rules: dict[str, list[str]]) -> Column:
    """Sorted names whose keywords occur; all of them if none does."""
    found = F.array_sort(F.array_compact(F.array(*[F.when(has_any(F.lower(text), [w.lower() for w in ws]), F.lit(n)) for n, ws in rules.items()])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(n) for n in sorted(rules)]))


def parse_labels(answer: Column, labels: list[str]) -> Column:
    """Labels in a model's JSON list: equal or one within the other, in any case; distinct, in order."""
    from folioforge.functions.text import first_json

    items = F.from_json(first_json(answer, "array"), "array<string>")

    def canonical(item: Column) -> Column:
        low = F.lower(F.trim(item))
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for label in labels:
            out = out.when(low == label.lower(), F.lit(label))
        for label in labels:
            out = out.when((F.length(low) > 0) & (F.contains(low, F.lit(label.lower())) | F.contains(F.lit(label.lower()), low)), F.lit(label))
        return out

    return F.coalesce(F.array_distinct(F.array_compact(F.transform(items, canonical))), F.array().cast("array<string>"))


def first_reason(rules: list[tuple[str, Column]], accepted: str = "accepted") -> Column:
    """The first rule's name whose condition holds: a cascade of filters that tells why."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, condition in rules:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(accepted))


def carry_forward(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """Fill ``column`` with its last non-null value before; the line-state machine."""
    over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(over))
