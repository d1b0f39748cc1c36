"""What a question asks for: field conditions and whether an exact look-up answers it, as columns over questions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.bind import let
from siftmill.functions.clauses import CODE, Told, before, first_value, marks
from siftmill.functions.parse import NOTE, PLATFORM
from siftmill.functions.text import fold_code, strip

# What a question calls a field before its value, and what the value is made of.
_WORDS, _PLAIN = r"[A-Za-z0-9_.-]+", r"[A-Za-z0-9]+"
_SIGN, _SIGN_EQUAL = "[:为是]?", "[:=为是]?"
KEYED = {
    "class_type": Told(("Class", "类别", "类型"), r"Class\d+", _SIGN),
    "lot_id": Told(("Lot ID", "批次号", "批次编号"), _WORDS, _SIGN),
    "product_id": Told(("ProductID", "产品编号", "产品ID", "产品"), _WORDS, _SIGN_EQUAL),
    "platform": Told(("平台", "Tech", "工艺平台"), _PLAIN, _SIGN),
    "station": Told(("站点", "Station", "工艺站点"), r"[A-Za-z0-9_]+", _SIGN),
    "machine": Told(("扫描机器", "机器", "Machine"), _PLAIN, _SIGN),
    "defect_type": Told(("缺陷类型", "Defect", "缺陷代码"), r"[A-Za-z0-9_]+", _SIGN),
    "map_location": Told(("Map位置", "Map分布"), r"[A-Za-z\s]+", _SIGN),
}
# Other names of fields, and the words that may follow a value.
_VERB = "(?:为|是|叫|等于|=|:)?"
NAMED = {
    f: Told(names, CODE, _VERB, apart=True)
    for f, names in {
        "dn_no": ("dn", "dn编号", "dn号"),
        "lot_id": ("lotid", "lot id", "lot", "批次", "批次号"),
        "platform": ("平台", "工艺平台", "tech"),
        "station": ("站点", "工艺站点", "station"),
        "machine": ("扫描机器", "机器", "机台", "machine"),
        "defect_type": ("缺陷类型", "缺陷", "defect"),
    }.items()
}
FOLLOWED = {"platform": ("工艺平台", "平台"), "machine": ("扫描机器", "机器", "机台"), "defect_type": ("缺陷类型", "缺陷"), "lot_id": ("LotID", "批次")}
#: "Which (defect) happens on (platform)", where no field is named.
RELATED = {"defect_type": Told(("哪些",), CODE + rf"(?=\s*发生在\s*{CODE})", ""), "platform": Told(("哪些",), CODE, rf"{CODE}\s*发生在")}
STRONG = ("dn_no", "lot_id", "machine", "platform", "station", "map_location", "dft_location")
FIELDS = ("dn_no", *KEYED)
EDGES = " \t\n\r,。;:."


def conditions(question: Column) -> Column:
    """MAP of field to value that a question names; empty for a NULL or empty one.

    Of a field the first of these counts: a label the question puts before the value, another name of the field, a name
    behind the value, the relation of defect and platform, and what a note would state.
    """
    grammar = {f"{way}:{f}": (t,) for way, rules in (("k", KEYED), ("n", NAMED), ("r", RELATED)) for f, t in rules.items()}
    grammar |= {f"s{i}:{f}": (t,) for f in FIELDS if f in NOTE for i, t in enumerate(NOTE[f])}

    def named(text: Column) -> Column:
        def fields(found: Column) -> Column:
            value = lambda key: first_value(found, grammar[key][0])
            out = []
            for f in FIELDS:
                ways = [F.nullif(F.regexp_extract(text, r"(?i)(?<![\p{L}\p{N}_])(DN-[A-Za-z0-9-]++)(?![\p{L}\p{N}_])", 1), F.lit(""))] if f == "dn_no" else [value(f"k:{f}")]
                ways += [value(f"n:{f}")] if f in NAMED else []
                ways += [before(text, FOLLOWED[f])] if f in FOLLOWED else []
                ways += [value(f"r:{f}")] if f in RELATED else []
                ways += [value(k) for k in grammar if k.startswith("s") and k.endswith(f":{f}")] if f in NOTE else [before(text, PLATFORM)]
                out.append(F.struct(F.lit(f).alias("key"), F.coalesce(*[F.nullif(F.btrim(w, F.lit(EDGES)), F.lit("")) for w in ways]).alias("value")))
            return F.map_from_entries(F.filter(F.array(*out), lambda e: e["value"].isNotNull()))

        return let(marks(text, grammar), fields)

    return let(strip(fold_code(F.coalesce(question, F.lit("")))), named)


def is_exact(question: Column, found: Column) -> Column:
    """Whether an exact filter answers the question: it names a strong field, a whole defect code (or says that it is one), or
    two fields."""
    defect = F.coalesce(F.try_element_at(found, F.lit("defect_type")), F.lit(""))
    code = (defect != "") & (F.coalesce(question, F.lit("")).contains("缺陷类型") | defect.rlike(r"^[A-Za-z][A-Za-z0-9.-]*_\d+$"))
    return F.arrays_overlap(F.map_keys(found), F.array(*[F.lit(f) for f in STRONG])) | code | (F.size(found) >= 2)


def understand(spark: SparkSession, question: str | None) -> tuple[dict[str, str], bool]:
    """Conditions and route of one question, by the same expressions; one row goes to the driver."""
    row = spark.range(1).select(F.lit(question).cast("string").alias("q")).select("q", conditions(F.col("q")).alias("c")).select("c", is_exact(F.col("q"), F.col("c")).alias("e")).first()
    return dict(row["c"]), bool(row["e"])
